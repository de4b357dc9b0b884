"""Queries on tiles, bags, attention and saliency."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from bagframe.functions import labels as L
from bagframe.operators import bags as BG
from bagframe.operators import encoders as E
from bagframe.operators import predict as P
from bagframe.operators import profile as PR
from bagframe.operators import saliency as SA
from bagframe.operators import tiles as TI
from bagframe.operators.scan import ordered_scan
from bagframe.operators.spec import CohortSpec, TrainType
from bagframe.plans import fixtures as fx
from bagframe.plans.registry import query

DIM = 64
BINARY = CohortSpec(TrainType.CLF, ("Neg", "Pos"))

# Stored tiles: little tissue means a constant (background) vector.
BG_TILES = "select name, i, j, tissue_frac, vec_id, cls, case when tissue_frac < 0.2 then null else feat end as feat from tiles"
# Attention as an arithmetic score per tile and class, for checks of everything after the network.
ATT = """select name, i, j, c.k as cls, cast((vec_id * (13 + 7 * c.k)) % 97 as double) / 20.0e0 as a_raw, feat, tissue_frac from tiles, range(0, 2) c(k)"""
SHAPES = "select name, max(i) + 1 as h, max(j) + 1 as w from tiles group by name"


def bg_tiles(spark, sf):
    t = fx.tiles(spark, sf)
    zero = F.array_repeat(F.lit(0.0).cast("float"), DIM)
    return t.withColumn("feat", F.when(F.col("tissue_frac") < 0.2, zero).otherwise(F.col("feat")))


def attention(spark, sf, background: bool = False):
    t = bg_tiles(spark, sf) if background else fx.tiles(spark, sf)
    t = t.withColumn("cls", F.explode(F.array(F.lit(0), F.lit(1))))
    a = ((F.col("vec_id") * (13 + 7 * F.col("cls"))) % 97).cast("double") / 20.0
    return t.select("name", "i", "j", "cls", a.alias("a_raw"), "feat", "tissue_frac")


def shapes(spark, sf):
    return fx.tiles(spark, sf).groupBy("name").agg((F.max("i") + 1).alias("h"), (F.max("j") + 1).alias("w"))


def slides(spark, sf):
    """Slide sizes in pixels from parts."""
    p = fx.table(spark, sf, "part")
    return p.select(F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("name"),
                    (F.col("p_size") * 10 + 3).cast("long").alias("height"), (F.col("p_size") * 7 + 1).cast("long").alias("width"))


# ---------------------------------------------------------------- grids and masks

@query("tile_grid", "name:s i:l j:l y:l x:l read_y:l read_x:l",
       """select name, i, j, i * 64 as y, j * 64 as x, i * 64 - 16 as read_y, j * 64 - 16 as read_x from (
            select name, i, unnest(range(0, cast(ceil(width / 64.0e0) as bigint))) as j from (
              select 's' || cast(p_partkey as varchar) as name, p_size * 7 + 1 as width, unnest(range(0, cast(ceil((p_size * 10 + 3) / 64.0e0) as bigint))) as i from part))""")
def _(spark, sf):
    """Grid cells with read offsets for stride 64 and patch 96."""
    return TI.tile_grid(slides(spark, sf), 64, 96)


@query("tissue_fractions", "name:s i:l j:l fraction:d",
       "select name, mi // 4 as i, mj // 4 as j, avg(cast(v > 0 as integer)) as fraction from masks group by all", "masks")
def _(spark, sf):
    """Share of tissue cells per tile, aligned masks."""
    return TI.aligned_mask_fraction(fx.masks(spark, sf), 4)


@query("tissue_fractions_scaled", "name:s i:l j:l fraction:d",
       """select t.name, t.i, t.j, sum(case when v = 1 then 1 else 0 end) / 36.0e0 as fraction from tiles t
          left join masks m on m.name = t.name and m.mi >= round_even(t.i * 16 * 0.25e0, 0) and m.mi < round_even(t.i * 16 * 0.25e0, 0) + 6
            and m.mj >= round_even(t.j * 16 * 0.25e0, 0) and m.mj < round_even(t.j * 16 * 0.25e0, 0) + 6 group by all""", ("tiles", "masks"))
def _(spark, sf):
    """Overlapping tiles of patch 24 and stride 16 on a mask at a quarter of the resolution, one mask label."""
    return TI.mask_fraction(fx.tiles(spark, sf), fx.masks(spark, sf), 24, 16, 0.25, label=1)


@query("tissue_tiles_kept", "name:s i:l j:l",
       "select name, i, j from tiles join (select name, mi // 4 as i, mj // 4 as j, avg(cast(v = 0 as integer)) as f from masks group by all) using (name, i, j) where f > 0.8", ("tiles", "masks"))
def _(spark, sf):
    """Tiles with more than the threshold share of a mask label."""
    return TI.keep_tissue(fx.tiles(spark, sf), TI.aligned_mask_fraction(fx.masks(spark, sf), 4, label=0), 0.8)


@query("padded_regions", "region:l name:s r:l c:l v:l",
       """select region, q.name, r, c, coalesce(v, 0) as v from (select row_number() over (order by name) as region, name from (select distinct name from tiles)) q,
            range(0, 5) a(r), range(0, 6) b(c) left join masks m on m.name = q.name and m.mi = r - 2 and m.mj = c + 16""", ("tiles", "masks"))
def _(spark, sf):
    """Regions across the border read as zero."""
    names = fx.tiles(spark, sf).select("name").distinct().withColumn("one", F.lit(1).cast("long"))
    numbered = ordered_scan(names, "name", [], ["one"], blocks=1)          # one row per bag
    regions = numbered.select(F.col("cum_one").alias("region"), "name", F.lit(-2).alias("y"), F.lit(16).alias("x"), F.lit(5).alias("h"), F.lit(6).alias("w"))
    return TI.padded_region(fx.masks(spark, sf), regions)


@query("sparse_tiles", "name:s i:l j:l x:l y:l", "select name, i, j, j * 256 as x, i * 256 as y from bg where feat is not null", "tiles", bg=BG_TILES)
def _(spark, sf):
    """Background dropped, coordinates added."""
    return TI.with_coordinates(TI.sparse_tiles(bg_tiles(spark, sf)), 256)


@query("shapes_from_coordinates", "name:s h:l w:l",
       "select name, max(i * 256) // 256 + 1 as h, max(j * 256) // 256 + 1 as w from bg where feat is not null group by name", "tiles", bg=BG_TILES)
def _(spark, sf):
    return TI.shape_from_coordinates(TI.with_coordinates(TI.sparse_tiles(bg_tiles(spark, sf)), 256))


@query("bags_stitched", "name:s i:l j:l first:d last:d",
       """select s.name, a.i, b.j, coalesce(feat[1], 0) as first, coalesce(feat[64], 0) as last from shapes s, range(0, 100000) a(i), range(0, 5) b(j)
          left join bg on bg.name = s.name and bg.i = a.i and bg.j = b.j where a.i < s.h and b.j < s.w""", "tiles",
       bg=BG_TILES, shapes=SHAPES)
def _(spark, sf):
    """Dense view of the sparse tiles: zeros where no tile is."""
    d = TI.stitch(TI.sparse_tiles(bg_tiles(spark, sf)), shapes(spark, sf), DIM, order="vec_id")
    return d.select("name", "i", "j", F.col("feat")[0].alias("first"), F.col("feat")[DIM - 1].alias("last"))


@query("background_distances", "name:s i:l j:l distance:d",
       """select a.name, a.i, a.j, sqrt(min(power(a.i - b.i, 2) + power(a.j - b.j, 2))) as distance from g a left join g b on a.name = b.name and b.t = 0 group by all""",
       "tiles", g="select name, i, j, case when (vec_id * 7) % 10 < 2 then 0 else 1 end as t from tiles")
def _(spark, sf):
    """Euclidean distance of every cell to the nearest background cell of its bag."""
    g = fx.tiles(spark, sf).withColumn("tissue", F.when((F.col("vec_id") * 7) % 10 < 2, 0).otherwise(1))
    return TI.background_distance(g)


@query("distance_map", "name:s i:l j:l weight:d",
       """select name, i, j, k / sum(k) over (partition by name) as weight from (select *, case when s < quantile_cont(s, 0.98) over (partition by name) then 0 else s end as k from (
            select *, power(d / max(d) over (partition by name), 2) as s from (
              select a.name, a.i, a.j, sqrt(min(power(a.i - b.i, 2) + power(a.j - b.j, 2))) as d from g a left join g b on a.name = b.name and b.t = 0 group by all)))""",
       "tiles", g="select name, i, j, case when (vec_id * 7) % 10 < 2 then 0 else 1 end as t from tiles")
def _(spark, sf):
    """Squared, cut at the 98th percentile, and normalised distances."""
    g = fx.tiles(spark, sf).withColumn("tissue", F.when((F.col("vec_id") * 7) % 10 < 2, 0).otherwise(1))
    return TI.distance_map(g)


@query("feature_map_normalised", "vec_id:l first:d total:d",
       """select vec_id, any_value(v) filter (p = 1) as first, sum(v) as total from (select vec_id, p, least(1, greatest(0, (x - lo) / (hi - lo + 1e-6))) as v from (
            select vec_id, name, unnest(range(1, 65)) as p, cast(unnest(feat) as double) as x from bg where feat is not null)
          join (select name, quantile_cont(x, 0.03) as lo, quantile_cont(x, 0.97) as hi from (select name, cast(unnest(feat) as double) as x from bg where feat is not null) where x <> 0 group by name) using (name)) group by vec_id""",
       "tiles", digits=5, bg=BG_TILES)
def _(spark, sf):
    """Vectors rescaled between the 3rd and 97th percentile of a bag's non-zero values."""
    t = TI.normalise_feature_map(TI.sparse_tiles(bg_tiles(spark, sf)))
    return t.select("vec_id", F.col("scaled")[0].alias("first"),
                    F.aggregate("scaled", F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0))).alias("total"))


@query("bag_infos", "name:s n:l w_dim:l h_dim:l width:l height:l code_size:l",
       "select name, count(*) as n, max(j) + 1 as w_dim, max(i) + 1 as h_dim, (max(j) + 1) * 256 as width, (max(i) + 1) * 256 as height, 64 as code_size from tiles group by name", "tiles")
def _(spark, sf):
    return TI.bag_info(fx.tiles(spark, sf), 256)


@query("grid_flipped", "name:s i:l j:l vec_id:l",
       "select name, h - 1 - i as i, w - 1 - j as j, vec_id from tiles join shapes using (name)", "tiles", shapes=SHAPES)
def _(spark, sf):
    return TI.flip(fx.tiles(spark, sf), shapes(spark, sf), True, True)


@query("grid_rotated", "name:s quarters:l i:l j:l vec_id:l",
       """select name, k as quarters, case k when 1 then w - 1 - j when 2 then h - 1 - i when 3 then j else i end as i,
            case k when 1 then i when 2 then w - 1 - j when 3 then h - 1 - i else j end as j, vec_id
          from (select *, cast('0x' || substr(md5('1:rot:' || name), 1, 15) as bigint) % 4 as k from tiles) join shapes using (name)""", "tiles", shapes=SHAPES)
def _(spark, sf):
    """A quarter-turn count chosen by a hash of the bag's name."""
    t = fx.tiles(spark, sf).withColumn("quarters", TI.random_choice("name", 1, "rot", 4))
    return TI.rotate(t, shapes(spark, sf), F.col("quarters"))


@query("grid_centre_cropped", "name:s i:l j:l vec_id:l",
       """select * from (select name, i - h // 2 + 1 as i, j - w // 2 + 1 as j, vec_id from tiles join shapes using (name)) where i between 0 and 2 and j between 0 and 2""",
       "tiles", shapes=SHAPES)
def _(spark, sf):
    """3 x 3 cells around the centre."""
    return TI.crop_pad(fx.tiles(spark, sf), shapes(spark, sf), (3, 3))


@query("grid_random_cropped", "name:s i:l j:l vec_id:l",
       """select * from (select name, i - least(greatest(h // 2 + (hi % (2 * ri + 1)) - ri, 0), h) + 1 as i, j - least(greatest(w // 2 + (hj % (2 * rj + 1)) - rj, 0), w) + 1 as j, vec_id from (
            select *, cast('0x' || substr(md5('1:i:' || name), 1, 15) as bigint) as hi, cast('0x' || substr(md5('1:j:' || name), 1, 15) as bigint) as hj,
              greatest(h - 2, 0) // 2 as ri, greatest(w - 2, 0) // 2 as rj from tiles join shapes using (name))) where i between 0 and 1 and j between 0 and 1""",
       "tiles", shapes=SHAPES)
def _(spark, sf):
    """2 x 2 cells around a centre moved by a hash of the name."""
    return TI.crop_pad(fx.tiles(spark, sf), shapes(spark, sf), (2, 2), wiggle=1.0)


_LEVELS = """select p_partkey, 's' || cast(p_partkey as varchar) as name, p_size / 40.0e0 as b, p_size * 1000 as w, p_size * 800 as h, p_retailprice as filesize from part"""


def _levels(spark, sf):
    p = fx.table(spark, sf, "part")
    b, w, h = F.col("p_size") / 40.0, F.col("p_size") * 1000, F.col("p_size") * 800
    sh = F.array(*[F.struct(F.floor(h / f).alias("h"), F.floor(w / f).alias("w")) for f in (1, 2, 4)])
    return p.select(F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("name"), F.array(b, 2 * b, 4 * b).alias("spacings"),
                    sh.alias("shapes"), F.col("p_retailprice").alias("filesize"))


def _near(sp: str) -> str:
    return f"least(abs(b - {sp}), abs(2 * b - {sp}), abs(4 * b - {sp})) <= {sp} * 0.25e0"


@query("slide_summaries", "name:s spacing:d width:l height:l n_levels:l spacing_min:d spacing_max:d area:l has_sp025:b has_sp05:b has_sp1:b has_sp2:b has_sp4:b has_sp8:b",
       f"""select name, b as spacing, w as width, h as height, 3 as n_levels, b as spacing_min, 4 * b as spacing_max, floor(cast(w as double) * h * (b * b) / 1e6) as area,
            {_near('0.25e0')} as has_sp025, {_near('0.5e0')} as has_sp05, {_near('1.0e0')} as has_sp1, {_near('2.0e0')} as has_sp2, {_near('4.0e0')} as has_sp4, {_near('8.0e0')} as has_sp8 from lv""",
       lv=_LEVELS)
def _(spark, sf):
    """Summary row per slide from its levels."""
    return TI.slide_summary(_levels(spark, sf))


@query("slide_totals", "n:l filesize_min:d filesize_max:d filesize_sum:d area_min:l area_max:l w_min:l w_max:l n_sp1:l",
       f"""select count(*) as n, min(filesize) as filesize_min, max(filesize) as filesize_max, sum(filesize) as filesize_sum, min(area) as area_min, max(area) as area_max,
            arg_min(w, {{'a': area, 'n': name}}) as w_min, arg_max(w, {{'a': area, 'n': name}}) as w_max, count(*) filter ({_near('1.0e0')}) as n_sp1
          from (select *, cast(floor(cast(w as double) * h * (b * b) / 1e6) as bigint) as area from lv)""", lv=_LEVELS, digits=3)
def _(spark, sf):
    """Totals of a slide collection."""
    t = PR.slide_totals(TI.slide_summary(_levels(spark, sf)), ["has_sp1"])
    return t.select("*", F.col("shape_min.w").alias("w_min"), F.col("shape_max.w").alias("w_max"))


# ---------------------------------------------------------------- attention and pooling

def _weights(heads: int = 2, hidden: int = 8) -> dict[str, np.ndarray]:
    h, d, k = np.arange(hidden)[:, None], np.arange(DIM)[None, :], np.arange(heads)[:, None]
    return {"V": ((h * 31 + d * 17) % 11 - 5) / 5.0, "U": ((h * 13 + d * 29) % 7 - 3) / 3.0, "b": (np.arange(hidden) % 3) / 10.0,
            "c": (np.arange(hidden) % 2) / 5.0, "w": ((k * 5 + np.arange(hidden)[None, :] * 3) % 9 - 4) / 2.0}


_NET = """select name, i, j, k.k as cls, sum(((k.k * 5 + h * 3) % 9 - 4) / 2.0e0 * ((exp(2 * v) - 1) / (exp(2 * v) + 1)) / (1 + exp(-u))) as a_raw from (
    select name, i, j, vec_id, h, sum(((h * 31 + d * 17) % 11 - 5) / 5.0e0 * x) + (h % 3) / 10.0e0 as v, sum(((h * 13 + d * 29) % 7 - 3) / 3.0e0 * x) + (h % 2) / 5.0e0 as u
    from (select name, i, j, vec_id, unnest(range(0, 64)) as d, cast(unnest(feat) as double) as x from tiles), range(0, 8) h(h) group by name, i, j, vec_id, h), range(0, 2) k(k) group by name, i, j, k.k"""


@query("attention_logits", "name:s i:l j:l cls:l a_raw:d", _NET, "tiles")
def _(spark, sf):
    """Gated attention of two heads over 64-wide vectors."""
    return BG.attention_logits(fx.tiles(spark, sf), _weights())


SOFT = """select *, e / sum(e) over (partition by name, cls) as a_soft from (select *, case when a > cast('-infinity' as double) then
    exp((a - max(a) over (partition by name, cls)) / {t}) else 0 end as e from {src})"""
MASKED = "select name, i, j, cls, feat, case when tissue_frac < 0.2 then cast('-infinity' as double) else a_raw end as a from att"
TOP5 = """select name, i, j, cls, feat, case when row_number() over (partition by name, cls order by a desc, i, j) <= 5 then a else cast('-infinity' as double) end as a from masked"""


@query("attention_softmax", "name:s cls:l i:l j:l a_soft:d", "select name, cls, i, j, a_soft from soft", "tiles", att=ATT, masked=MASKED,
       soft=SOFT.format(t="1.0e0", src="masked"))
def _(spark, sf):
    """Softmax over the tiles of a bag, background masked."""
    return BG.attention_softmax(BG.mask_background(attention(spark, sf, True)))


@query("attention_softmax_temperature", "name:s cls:l i:l j:l a_soft:d", "select name, cls, i, j, a_soft from soft", "tiles", att=ATT, masked=MASKED,
       soft=SOFT.format(t="sqrt(count(*) filter (a > cast('-infinity' as double)) over (partition by name, cls))", src="masked"))
def _(spark, sf):
    """Temperature: root of the number of unmasked tiles."""
    return BG.attention_softmax(BG.mask_background(attention(spark, sf, True)), "sqrt")


@query("attention_top_k", "name:s cls:l i:l j:l a_soft:d", "select name, cls, i, j, a_soft from soft", "tiles", att=ATT, masked=MASKED, top5=TOP5,
       soft=SOFT.format(t="1.0e0", src="top5"))
def _(spark, sf):
    """Only the five largest attentions of a bag and class are kept."""
    return BG.attention_softmax(BG.keep_top_k(BG.mask_background(attention(spark, sf, True)), 5))


@query("attention_heads_summed", "name:s i:l j:l a_soft:d", "select name, i, j, sum(a_soft) as a_soft from soft group by all", "tiles", att=ATT, masked=MASKED,
       soft=SOFT.format(t="1.0e0", src="masked"))
def _(spark, sf):
    a = BG.attention_softmax(BG.mask_background(attention(spark, sf, True)))
    return BG.sum_heads(a)


_BAGS = """select name, cls, p, sum(a_soft * x) as m from (select name, cls, a_soft, unnest(range(0, 64)) as p, cast(unnest(feat) as double) as x
    from soft where a_soft > 0) group by all"""
BAG_STEPS = dict(att=ATT, masked=MASKED, soft=SOFT.format(t="1.0e0", src="masked"), bags=_BAGS)


def _soft(spark, sf):
    return BG.attention_softmax(BG.mask_background(attention(spark, sf, True)))


@query("bag_vectors", "name:s cls:l p:l m:d", "select name, cls, p, m from bags", "tiles", **BAG_STEPS)
def _(spark, sf):
    """Attention-weighted sums per dimension, one partial row per task and bag."""
    return BG.bag_vectors(_soft(spark, sf), DIM).select("name", "cls", F.posexplode("m").alias("p", "m"))


@query("bag_vectors_wide", "name:s cls:l p:l m:d", "select name, cls, p, m from bags", "tiles", **BAG_STEPS)
def _(spark, sf):
    """The same through Arrow batches, the way for wide vectors."""
    return BG.bag_vectors(_soft(spark, sf), DIM).select("name", "cls", F.posexplode("m").alias("p", "m"))


W2 = [[((c * 7 + d * 3) % 5 - 2) / 4.0 for d in range(DIM)] for c in range(2)]


@query("linear_head", "name:s cls:l logit0:d logit1:d",
       """select name, cls, sum(m * ((p * 3) % 5 - 2) / 4.0e0) + 0.1e0 as logit0, sum(m * ((7 + p * 3) % 5 - 2) / 4.0e0) - 0.2e0 as logit1 from bags group by all""",
       "tiles", **BAG_STEPS)
def _(spark, sf):
    return BG.linear_head(BG.bag_vectors(_soft(spark, sf), DIM), W2, [0.1, -0.2])


@query("per_class_head", "name:s logit0:d logit1:d",
       """select name, sum(case when cls = 0 then m * ((p * 3) % 5 - 2) / 4.0e0 end) + 0.1e0 as logit0, sum(case when cls = 1 then m * ((7 + p * 3) % 5 - 2) / 4.0e0 end) - 0.2e0 as logit1
          from bags group by name""", "tiles", **BAG_STEPS)
def _(spark, sf):
    """Class c reads the bag vector of head c."""
    return BG.per_class_head(BG.bag_vectors(_soft(spark, sf), DIM), W2, [0.1, -0.2])


@query("additive_head", "name:s logit0:d logit1:d",
       """select name, sum(logit0) as logit0, sum(logit1) as logit1 from (select name, i, j, a_soft * sum(x * ((p * 3) % 5 - 2) / 4.0e0) + 0.1e0 as logit0,
            a_soft * sum(x * ((7 + p * 3) % 5 - 2) / 4.0e0) - 0.2e0 as logit1 from (
              select name, i, j, a_soft, unnest(range(0, 64)) as p, cast(unnest(feat) as double) as x from soft where cls = 0) group by name, i, j, a_soft) group by name""",
       "tiles", att=ATT.replace("feat,", "case when tissue_frac < 0.2 then list_transform(feat, lambda v: 0) else feat end as feat,"),
       masked=MASKED, soft=SOFT.format(t="1.0e0", src="masked"))
def _(spark, sf):
    """Per-tile logits added up per bag."""
    a = _soft(spark, sf).where("cls = 0")
    return BG.additive_head(a, W2, [0.1, -0.2])[1]


@query("extreme_instances", "name:s cls:l side:s i:l j:l",
       """select name, cls, 'top' as side, i, j from (select *, row_number() over (partition by name, cls order by a_raw desc, i, j) as r, least(count(*) over (partition by name, cls) // 2, 8) as k from att) where r <= k
          union all select name, cls, 'bottom', i, j from (select *, row_number() over (partition by name, cls order by a_raw, i, j) as r, least(count(*) over (partition by name, cls) // 2, 8) as k from att) where r <= k""",
       "tiles", att=ATT)
def _(spark, sf):
    """Highest and lowest instances of every bag."""
    return BG.extreme_instances(attention(spark, sf))


def _peak_rounds(rounds: int = 10) -> dict[str, str]:
    """Ten fixed rounds of peak suppression; rounds after the peaks are stable change nothing."""
    ctes = {"r0": "select name, cls, i, j, a_raw as v, min(a_raw) over (partition by name, cls) as low from att"}
    near = "a.name = b.name and a.cls = b.cls and abs(a.i - b.i) <= 1 and abs(a.j - b.j) <= 1"
    for k in range(rounds):
        ctes[f"p{k}"] = (f"select a.name, a.cls, a.i, a.j, any_value(a.v) as v, any_value(a.low) as low, "
                         f"max({{'v': b.v, 'bi': -b.i, 'bj': -b.j}}) = {{'v': any_value(a.v), 'bi': -a.i, 'bj': -a.j}} as peak "
                         f"from r{k} a join r{k} b on {near} group by a.name, a.cls, a.i, a.j")
        ctes[f"r{k + 1}"] = (f"select a.name, a.cls, a.i, a.j, case when not any_value(a.peak) and bool_or(b.peak) then any_value(a.low) "
                             f"else any_value(a.v) end as v, any_value(a.low) as low from p{k} a join p{k} b on {near} group by a.name, a.cls, a.i, a.j")
    return ctes


@query("attention_peaks", "name:s cls:l i:l j:l a_raw:d", "select name, cls, i, j, v as a_raw from r10", "tiles", att=ATT, **_peak_rounds())
def _(spark, sf):
    """Non-peak cells near a peak set to the smallest value, until stable."""
    return BG.suppress_non_peaks(attention(spark, sf))


@query("pooled_bags", "how:s name:s p:l m:d",
       """select 'avg' as how, name, p, avg(x) as m from x group by all union all select 'max', name, p, max(x) from x group by all
          union all select 'gem', name, p, power(avg(power(greatest(x, 1e-6), 3)), 1 / 3.0e0) from x group by all""", "tiles",
       x="select name, unnest(range(0, 64)) as p, cast(unnest(feat) as double) as x from tiles")
def _(spark, sf):
    """Average, maximum and power-mean pooling."""
    t, out = fx.tiles(spark, sf), None
    for how in ("avg", "max", "gem"):
        b = BG.pool_bags(t, DIM, how).select(F.lit(how).alias("how"), "name", F.posexplode("m").alias("p", "m"))
        out = b if out is None else out.unionByName(b)
    return out


@query("bags_scored", "name:s logit0:d logit1:d out0:d out1:d",
       """select name, l0 as logit0, l1 as logit1, exp(l0) / (exp(l0) + exp(l1)) as out0, exp(l1) / (exp(l0) + exp(l1)) as out1 from (
            select name, sum(case when cls = 0 then m * ((p * 3) % 5 - 2) / 4.0e0 end) + 0.1e0 as l0, sum(case when cls = 1 then m * ((7 + p * 3) % 5 - 2) / 4.0e0 end) - 0.2e0 as l1 from bags group by name)""",
       "tiles", net=_NET, att="select net.*, feat, tissue_frac from net join tiles using (name, i, j)", masked=MASKED, top5=TOP5,
       soft=SOFT.format(t="1.0e0", src="top5"), bags=_BAGS)
def _(spark, sf):
    """Attention network, mask, top-k, softmax, pooling, heads and output function in one plan."""
    scored = BG.score_bags(bg_tiles(spark, sf), _weights(), (W2, [0.1, -0.2]), DIM, topk=5)
    return P.add_scores(scored, BINARY, ["logit0", "logit1"])


@query("bag_vectors_one_pass", "name:s cls:l p:l m:d",
       "select name, cls, p, m from bags", "tiles", net=_NET, att="select net.*, feat, tissue_frac from net join tiles using (name, i, j)",
       masked=MASKED, soft=SOFT.format(t="1.0e0", src="masked"), bags=_BAGS)
def _(spark, sf):
    """Attention network, mask, softmax and pooling in a single pass over the vectors."""
    return BG.pool_with_attention(bg_tiles(spark, sf), _weights(), DIM).select("name", "cls", F.posexplode("m").alias("p", "m"))


@query("tile_attention_from_bag_totals", "name:s cls:l i:l j:l a_soft:d", "select name, cls, i, j, a_soft from soft", "tiles", net=_NET,
       att="select net.*, feat, tissue_frac from net join tiles using (name, i, j)", masked=MASKED, soft=SOFT.format(t="1.0e0", src="masked"))
def _(spark, sf):
    """Softmax of every tile from the bag totals of the one-pass pooling."""
    t = bg_tiles(spark, sf)
    return BG.tile_attention(t, _weights(), BG.pool_with_attention(t, _weights(), DIM))


@query("bag_classifier_fit", "name:s split:s out1:d")
def _(spark, sf):
    """Weighted logistic regression on pooled bags, regularisation by validation AUC."""
    t = fx.tiles(spark, sf)
    bags = BG.pool_bags(t, DIM).join(t.groupBy("name").agg((F.sum("cls") % 2).cast("int").alias("y"), F.min("vec_id").alias("k")), "name")
    split = F.when(F.col("k") % 5 < 3, "training").when(F.col("k") % 5 == 3, "validation").otherwise("testing")
    bags = bags.withColumn("split", split).withColumn("weight", F.when(F.col("y") == 1, 1.5).otherwise(1.0))
    return BG.fit_bag_classifier(bags, "y", weight="weight")[0]


# ---------------------------------------------------------------- encoders

_BINS = [f"h{k}" for k in range(16)]


@query("tiles_encoded_bands", "vec_id:l mean:d std:d min:d max:d " + " ".join(f"{b}:d" for b in _BINS),
       """select vec_id, avg(x) as mean, stddev_pop(x) as std, min(x) as min, max(x) as max, """
       + ", ".join(f"avg(cast({'x >= ' + str(-1 + k / 8) if k else 'true'} and {'x < ' + str(-0.875 + k / 8) if k < 15 else 'true'} as integer)) as h{k}" for k in range(16))
       + " from (select vec_id, cast(unnest(embedding) as double) as x from embeddings) group by vec_id", digits=5)
def _(spark, sf):
    """Band statistics of 8 x 8 tiles in Arrow batches."""
    t = fx.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("pixels"))
    e = E.encode_tiles(t, "bands", (8, 8, 1), batch_size=64, bins=16, low=-1.0, high=1.0)
    return e.select("vec_id", *[F.col("feat")[k].alias(n) for k, n in enumerate(("mean", "std", "min", "max", *_BINS))])


def _orbit_weights() -> str:
    """Values (pixel, feature, weight): the projection's weights averaged over the eight places a pixel takes."""
    m = np.random.default_rng(1).standard_normal((64, 4)) / 8.0
    rows = []
    for i in range(8):
        for j in range(8):
            places = [(i, j), (7 - j, i), (7 - i, 7 - j), (j, 7 - i)]
            places += [(7 - a, b) for a, b in places]
            w = sum(m[8 * a + b] for a, b in places) / 8
            rows += [f"({8 * i + j + 1}, {k}, {w[k]!r}::double)".replace("np.float64(", "").replace(")::", "::") for k in range(4)]
    return "select * from (values " + ", ".join(rows) + ") t(p, k, w)"


@query("tiles_encoded_eight_views", "vec_id:l f0:d f1:d f2:d f3:d",
       "select vec_id, " + ", ".join(f"sum(case when k = {k} then x * w end) as f{k}" for k in range(4)) + """ from (
            select vec_id, unnest(range(1, 65)) as p, (unnest(embedding) * 100.0e0 + 128) / 255.0e0 * 2 - 1 as x from embeddings) join orbit using (p) group by vec_id""",
       digits=4, orbit=_orbit_weights())
def _(spark, sf):
    """A fixed random projection averaged over the eight flips and turns."""
    t = fx.table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: v * 100 + 128).alias("pixels"))
    e = E.encode_tiles(t, "projection", (8, 8, 1), normalise="-11", augment="rot8m", size=4)
    return e.select("vec_id", *[F.col("feat")[k].alias(f"f{k}") for k in range(4)])


# ---------------------------------------------------------------- saliency

_U8 = "greatest(0, least(255, cast(trunc({e}) as integer)))"


@query("saliency_maps_scaled", "name:s cls:l i:l j:l level:l",
       f"""select name, cls, i, j, case when a = cast('-infinity' as double) then 0 else {_U8.format(e='(a - lo) / (hi - lo) * 255')} end as level from (
            select *, min(case when a > cast('-infinity' as double) then a end) over (partition by name, cls) as lo, max(a) over (partition by name, cls) as hi from masked)""",
       "tiles", att=ATT, masked=MASKED)
def _(spark, sf):
    """0..255 between the smallest finite and the largest attention of a map."""
    return SA.attention_map(BG.mask_background(attention(spark, sf, True)))


@query("saliency_maps_by_class", "name:s cls:l i:l j:l level:l",
       f"""select name, cls, i, j, {_U8.format(e='exp(a_raw - hi) / sum(exp(a_raw - hi)) over (partition by name, i, j) * 255')} as level from (
            select *, max(a_raw) over (partition by name, i, j) as hi from att)""", "tiles", att=ATT)
def _(spark, sf):
    """Softmax over classes per cell."""
    return SA.attention_map(attention(spark, sf), "softmax")


@query("saliency_maps_sigmoid_and_tiles", "kind:s name:s cls:l i:l j:l level:l",
       f"""select 'sigm' as kind, name, cls, i, j, {_U8.format(e='1 / (1 + exp(-a_raw)) * 255')} as level from att
          union all select 'tiles', name, cls, i, j, {_U8.format(e='exp(a_raw - hi) / sum(exp(a_raw - hi)) over (partition by name, cls) * 255')} from (
            select *, max(a_raw) over (partition by name, cls) as hi from att)""", "tiles", att=ATT)
def _(spark, sf):
    a = attention(spark, sf)
    return SA.attention_map(a, "sigm").withColumn("kind", F.lit("sigm")).unionByName(
        SA.attention_map(a, "tiles").withColumn("kind", F.lit("tiles")))


@query("saliency_maps_enlarged", "name:s i:l j:l level:l",
       """select t.name, i * 3 + r as i, j * 3 + c as j, vec_id % 256 as level from tiles t
          join (select name, (max(i) + 1) * 3 - 1 as h, (max(j) + 1) * 3 - 2 as w from tiles group by name) s on s.name = t.name, range(0, 3) r(r), range(0, 3) c(c)
          where i * 3 + r < h and j * 3 + c < w""", "tiles")
def _(spark, sf):
    """Nearest-neighbour enlargement by three, cropped to the slide."""
    t = fx.tiles(spark, sf).select("name", "i", "j", (F.col("vec_id") % 256).alias("level"))
    s = shapes(spark, sf).select("name", (F.col("h") * 3 - 1).alias("h"), (F.col("w") * 3 - 2).alias("w"))
    return SA.upscale(t, 3, s)


@query("salient_tiles", "name:s cls:l rank:l x:l y:l score:s",
       """select name, cls, r as rank, j * 256 as x, i * 256 as y, printf('%.4f', a_raw) as score from (
            select *, row_number() over (partition by name, cls order by a_raw desc, i, j) as r from att) where r <= 9""", "tiles", att=ATT)
def _(spark, sf):
    """The nine most salient tiles per map with coordinates and score text."""
    return SA.salient_tiles(attention(spark, sf), 256)


@query("slides_to_map", "name:s top_label:l correct:b link:s",
       """select name, Pos as top_label, ok as correct, t || '-' || p as link from (select *, row_number() over (partition by Pos, ok order by name) as r from (
            select name, Pos, (out1 > out0) = (Pos = 1) as ok, case when Pos = 1 then 'Pos' else 'Neg' end as t, case when out1 > out0 then 'Pos' else 'Neg' end as p
            from preds where split <> 'training')) where r <= case when ok then 12 else 7 end""", "preds")
def _(spark, sf):
    """Slides that get a map: caps per label and correctness, with their link name."""
    df = P.add_predictions(fx.preds(spark, sf), BINARY)
    return SA.slides_to_map(df, BINARY, 12, 7, ["validation", "testing"])


@query("link_names_multilabel", "name:s link:s",
       """select name, replace(concat_ws('_', case when toxic = 1 then 'toxic' end, case when quality = 1 then 'quality' end, case when other = 1 then 'other' end)
            || '__' || concat_ws('_', case when out2 >= 0.5 then 'toxic' end, case when out1 >= 0.5 then 'quality' end, case when out0 >= 0.5 then 'other' end), '__', '-') as link from preds_ml""",
       "preds_ml")
def _(spark, sf):
    spec = CohortSpec(TrainType.MULTILABEL, ("other", "quality", "toxic"))
    df = P.add_predictions(fx.preds_ml(spark, sf), spec)
    return df.withColumn("link", L.link_name(L.label_indices(spec.target_cols), L.label_indices(["pred0", "pred1", "pred2"]), spec.target_cols))


_ENS = "select name, i, j, cls, m.m as member, a_raw + ((vec * (m.m + 1)) % 5) / 10.0e0 as a_raw from (select *, i * 5 + j as vec from att), range(0, 3) m(m)"


def _attention_members(spark, sf):
    a = attention(spark, sf).withColumn("member", F.explode(F.array(*[F.lit(m) for m in range(3)])))
    shift = (((F.col("i") * 5 + F.col("j")) * (F.col("member") + 1)) % 5) / 10.0
    return a.select("name", "cls", "i", "j", "member", (F.col("a_raw") + shift).alias("a_raw"))


@query("attention_ensemble", "name:s cls:l i:l j:l a_raw:d a_raw_std:d",
       "select name, cls, i, j, avg(a_raw) as a_raw, stddev_pop(a_raw) as a_raw_std from ens group by all", "tiles", att=ATT, ens=_ENS)
def _(spark, sf):
    """Mean and population deviation of attention over three models."""
    return P.ensemble_attention(_attention_members(spark, sf))


@query("saliency_maps_of_ensemble", "name:s cls:l i:l j:l level:l",
       f"""select name, cls, i, j, {_U8.format(e='(a - min(a) over (partition by name, cls)) / (max(a) over (partition by name, cls) - min(a) over (partition by name, cls)) * 255')} as level
          from (select name, cls, i, j, avg(a_raw) as a from ens group by all)""", "tiles", att=ATT, ens=_ENS)
def _(spark, sf):
    """Merged maps of several models."""
    return SA.attention_map(P.ensemble_attention(_attention_members(spark, sf)))
