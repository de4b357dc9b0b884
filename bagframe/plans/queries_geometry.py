"""Queries on annotations and geometry. Annotations are derived from tiles: rectangles per tile, a polygon per bag."""

from __future__ import annotations

from pyspark.sql import functions as F

from bagframe.operators import annotations as AN
from bagframe.operators import geometry as GE
from bagframe.plans import fixtures as fx
from bagframe.plans.oracle_parts import merged_boxes
from bagframe.plans.registry import query
from bagframe.sources import annotations_xml as X

# One annotation per tile: rectangles (vec_id % 3 = 0), triangles (1), dots (2); coordinates as lists xs and ys.
ANNOS = """select name as file, 't' || cast(vec_id as varchar) as name, vec_id as pos,
    case vec_id % 3 when 0 then 'Rectangle' when 1 then 'Polygon' else 'Dot' end as type, 'g' || cast(vec_id % 4 as varchar) as "group",
    case vec_id % 3 when 0 then [x, x + 30, x + 30, x] when 1 then [x, x + 40, x + 10] else [x] end as xs,
    case vec_id % 3 when 0 then [y, y, y + 20, y + 20] when 1 then [y, y + 5, y + 30] else [y] end as ys
  from (select *, cast(j * 50 + vec_id % 11 as double) as x, cast(i * 50 + vec_id % 7 as double) as y from tiles)"""


def annos(spark, sf):
    t = fx.tiles(spark, sf)
    x, y, k = (F.col("j") * 50 + F.col("vec_id") % 11).cast("double"), (F.col("i") * 50 + F.col("vec_id") % 7).cast("double"), F.col("vec_id") % 3

    def p(a, b):
        return F.struct(a.alias("x"), b.alias("y"))

    rect = F.array(p(x, y), p(x + 30, y), p(x + 30, y + 20), p(x, y + 20))
    tri = F.array(p(x, y), p(x + 40, y + 5), p(x + 10, y + 30))
    return t.select(
        F.col("name").alias("file"), F.concat(F.lit("t"), F.col("vec_id").cast("string")).alias("name"), F.col("vec_id").alias("pos"),
        F.when(k == 0, "Rectangle").when(k == 1, "Polygon").otherwise("Dot").alias("type"),
        F.concat(F.lit("g"), (F.col("vec_id") % 4).cast("string")).alias("group"), F.lit("#000000").alias("color"),
        F.when(k == 0, rect).when(k == 1, tri).otherwise(F.array(p(x, y))).alias("coords"))


def groups(spark, sf):
    a = annos(spark, sf).groupBy("file", "group").agg(F.min("pos").alias("pos"))
    return a.select("file", F.col("group").alias("name"), F.lit("None").alias("parent"),
                    F.concat(F.lit("#00000"), F.substring("group", 2, 1)).alias("color"), "pos")


GROUPS = """select file, "group" as name, 'None' as parent, '#00000' || substr("group", 2, 1) as color, min(pos) as pos from annos group by file, "group" """
POINTS = "select file, name, type, \"group\", unnest(range(1, len(xs) + 1)) as k, unnest(xs) as x, unnest(ys) as y from {src}"
PTS = dict(annos=ANNOS, pts=POINTS.format(src="annos"))
LONG = "file:s name:s type:s k:l x:d y:d"


def points(df):
    """(file, name, type, k, x, y) with 1-based vertex numbers."""
    return df.select("file", "name", "type", "group", F.posexplode("coords").alias("k", "p")).select(
        "file", "name", "type", "group", (F.col("k") + 1).alias("k"), "p.x", "p.y")


@query("annotations_scaled", LONG, "select file, name, type, k, round_even(x * 0.3e0, 0) as x, round_even(y * 0.3e0, 0) as y from pts", "tiles", **PTS)
def _(spark, sf):
    """Scaled by a spacing ratio and rounded half to even."""
    return points(AN.scale(annos(spark, sf), from_spacing=0.3, to_spacing=1.0, round_result=True))


@query("annotations_shifted", LONG, "select file, name, type, k, x + 3.5e0 as x, y - 2 as y from pts", "tiles", **PTS)
def _(spark, sf):
    return points(AN.shift(annos(spark, sf), 3.5, -2.0))


@query("annotations_unshifted_by_name", "file:s form:s name:s k:l x:d y:d",
       """select file, f.form, name, k, x + 12 as x, y + 150 as y from pts, (select unnest(['__', 'tl', 'tl_br']) as form) f""", "tiles", **PTS)
def _(spark, sf):
    """Offset read from the end of the file name, three name forms."""
    a, out = annos(spark, sf), None
    for form, ending in (("__", "__12_150"), ("tl", "_12_150"), ("tl_br", "_12_150_90_200")):
        named = a.withColumn("file", F.concat("file", F.lit(ending)))
        b = points(AN.unshift_by_name(named, form)).withColumn("form", F.lit(form))
        out = b if out is None else out.unionByName(b)
    return out


@query("annotation_groups_edited", "part:s file:s name:s color:s",
       """select 'anno' as part, file, 'p_' || name || '_s' as name, case when "group" in ('g0', 'g1') then 'merged' else "group" end as color from annos where "group" <> 'g3'
          union all select 'group', file, n, case when n = 'merged' then '#FFFFFF' else arg_min(color, pos) end from (select *, case when name in ('g0', 'g1') then 'merged' else name end as n from groups where name <> 'g3') group by file, n""",
       "tiles", annos=ANNOS, groups=GROUPS)
def _(spark, sf):
    """Group deleted, two groups renamed to one, recoloured, names with prefix and suffix."""
    a, g = AN.delete_groups(annos(spark, sf), groups(spark, sf), ["g3"])
    a, g = AN.rename_groups(a, g, {"g0": "merged", "g1": "merged"})
    g = AN.recolour_groups(g, {"merged": "#FFFFFF"})
    a = AN.affix_names(a, "p_", "_s")
    return a.select(F.lit("anno").alias("part"), "file", "name", F.col("group").alias("color")).unionByName(
        g.select(F.lit("group").alias("part"), "file", "name", "color"))


@query("annotation_groups_kept", "file:s name:s", """select file, name from annos where "group" in ('g1', 'g2')""", "tiles", annos=ANNOS)
def _(spark, sf):
    """Only some groups kept."""
    return AN.keep_groups(annos(spark, sf), groups(spark, sf), ["g1", "g2"])[0]


@query("annotations_selected_and_removed", "file:s name:s", """select file, name from annos where "group" = 'g2' and name not in ('t2', 't6')""", "tiles", annos=ANNOS)
def _(spark, sf):
    return AN.remove_annotations(AN.in_groups(annos(spark, sf), ["g2"]), ["t2", "t6"])


@query("annotation_sets_merged", "part:s file:s name:s",
       """select 'anno' as part, file, name || ' old' as name from annos where pos % 2 = 0 union all select 'anno', file, name || ' new' from annos where pos % 2 = 1
          union all select distinct 'group', file, "group" from annos""", "tiles", annos=ANNOS)
def _(spark, sf):
    """Two annotation sets of the same files: groups united by name, all annotations kept."""
    a, g = annos(spark, sf), groups(spark, sf)
    a1, a2 = a.where("pos % 2 = 0"), a.where("pos % 2 = 1")
    m, mg = AN.merge_sets(a1, g.where("pos % 2 = 0"), a2, g, suffix1=" old")
    return m.select(F.lit("anno").alias("part"), "file", "name").unionByName(mg.select(F.lit("group").alias("part"), "file", "name"))


@query("shapes_to_dots", "file:s name:s x:d y:d",
       """select file, name || '_dot' as name, case when type = 'Rectangle' then xs[1] + 15 else (xs[1] + xs[2] + xs[3]) / 3 end as x,
            case when type = 'Rectangle' then ys[1] + 10 else (ys[1] + ys[2] + ys[3]) / 3 end as y from annos where type <> 'Dot'""", "tiles", annos=ANNOS)
def _(spark, sf):
    """Area centroids of rectangles and polygons, added under a suffixed name."""
    d = AN.to_dots(annos(spark, sf)).where(F.col("name").endswith("_dot"))
    return d.select("file", "name", F.col("coords")[0]["x"].alias("x"), F.col("coords")[0]["y"].alias("y"))


@query("dots_to_boxes", "file:s name:s k:l x:d y:d",
       """select file, name, k, xs[1] + case when k <= 2 then 6 else -6 end as x, ys[1] + case when k in (1, 4) then 6 else -6 end as y
          from annos, range(1, 5) t(k) where type = 'Dot'""", "tiles", annos=ANNOS)
def _(spark, sf):
    """Dots replaced by squares of 3 micrometres at half a micrometre per pixel."""
    b = AN.dots_to_boxes(annos(spark, sf).where("type = 'Dot'"), 3.0, replace=True, spacing=0.5)
    return points(b)


@query("rectangles_from_size", "vec_id:l k:l x:d y:d",
       """select vec_id, k, cast(j * 10 + case when k in (2, 3) then 5 else 0 end as double) as x, cast(i * 10 + case when k >= 3 then 8 else 0 end as double) as y from tiles, range(1, 5) t(k)""", "tiles")
def _(spark, sf):
    t = fx.tiles(spark, sf)
    r = AN.rectangle(F.col("j") * 10, F.col("i") * 10, F.lit(5), F.lit(8))
    return t.select("vec_id", F.posexplode(r).alias("k", "p")).select("vec_id", (F.col("k") + 1).alias("k"), "p.x", "p.y")


@query("annotation_info", "file:s name:s type:s n_coords:l broken:b same:b",
       "select file, name, type, len(xs) as n_coords, false as broken, pos % 2 = 0 as same from annos", "tiles", annos=ANNOS)
def _(spark, sf):
    """Type, number of coordinates, broken polygons, and equality with a changed copy."""
    a = annos(spark, sf)
    moved = AN.shift(a, F.when(F.col("pos") % 2 == 0, 0.0).otherwise(1.0), 0.0)
    return AN.info(a).join(AN.same_coordinates(a, moved), ["file", "name"])


@query("polygon_areas", "file:s name:s area:d mm2:d",
       """select file, name, case when type = 'Rectangle' then 600.0e0 else abs((xs[1] * ys[2] - xs[2] * ys[1]) + (xs[2] * ys[3] - xs[3] * ys[2]) + (xs[3] * ys[1] - xs[1] * ys[3])) / 2 end as area,
            case when type = 'Rectangle' then 600.0e0 else abs((xs[1] * ys[2] - xs[2] * ys[1]) + (xs[2] * ys[3] - xs[3] * ys[2]) + (xs[3] * ys[1] - xs[1] * ys[3])) / 2 end * 0.25e0 / 1e6 as mm2
          from annos where type <> 'Dot'""", "tiles", annos=ANNOS, digits=9)
def _(spark, sf):
    """Shoelace areas in pixels and square millimetres."""
    a = annos(spark, sf).where("type <> 'Dot'")
    return a.select("file", "name", GE.polygon_area("coords").alias("area"), GE.area_mm2("coords", 0.5).alias("mm2"))


@query("contours_to_annotations", "file:s name:s k:l x:d y:d",
       """select file, name || '_area_' || case when area * 400 / 1e6 < 1e-3 then printf('%.2e', area * 400 / 1e6) else printf('%.3f', area * 400 / 1e6) end as name, k, y * 2 as x, x * 2 as y
          from (select file, name, type, unnest(range(1, len(xs) + 1)) as k, unnest(xs) as x, unnest(ys) as y,
            case when type = 'Rectangle' then 600.0e0 else abs((xs[1] * ys[2] - xs[2] * ys[1]) + (xs[2] * ys[3] - xs[3] * ys[2]) + (xs[3] * ys[1] - xs[1] * ys[3])) / 2 end as area from annos where len(xs) >= 3)
          where area * 400 / 1e6 >= 0.2e0""", "tiles", annos=ANNOS)
def _(spark, sf):
    """Contours to polygon annotations: area in the name, small ones dropped, scaled, x and y swapped."""
    a = annos(spark, sf)
    out = GE.contours_to_annotations(a, spacing=20.0, slide_spacing=10.0, min_area=0.2, swap_xy=True, keep=("file", "group"))
    return points(out)


@query("contour_distances", "file:s a:s b:s distance:d",
       """select p.file, p.name as a, q.name as b, min(sqrt(power(p.x - q.x, 2) + power(p.y - q.y, 2))) as distance from pts p join pts q on p.file = q.file and p.name < q.name
          group by all having min(power(p.x - q.x, 2) + power(p.y - q.y, 2)) <= 1600""", "tiles", **PTS)
def _(spark, sf):
    """Smallest vertex distance of contours at most 40 pixels apart."""
    return GE.contour_distances(annos(spark, sf), 40.0)


@query("annotations_overlapping_region", "file:s region:s name:s",
       """select a.file, r.region, a.name from annos a join (select name as file, 'r' || cast(k as varchar) as region, k * 60.0e0 + 20 as x0, k * 60.0e0 + 75 as x1, 10.0e0 as y0, 1000000.0e0 as y1
              from (select distinct name from tiles), range(0, 3) t(k)) r on a.file = r.file
          where a.type <> 'Polygon' and case when a.type = 'Dot' then xs[1] > x0 and xs[1] < x1 and ys[1] > y0 and ys[1] < y1
            else xs[1] <= x1 and xs[2] >= x0 and ys[1] <= y1 and ys[3] >= y0 end""", "tiles", annos=ANNOS)
def _(spark, sf):
    """Annotations that intersect region polygons of their file; points strictly inside."""
    a = annos(spark, sf)
    top = a.agg(F.max(GE.bounds("coords")["y1"])).scalar()
    regions = a.select("file").distinct().withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(3)])))
    x0, x1 = F.col("k") * 60.0 + 20, F.col("k") * 60.0 + 75
    regions = regions.select("file", F.concat(F.lit("r"), F.col("k").cast("string")).alias("name"),
                             AN.rectangle(x0, F.lit(10.0), x1 - x0, top).alias("coords"))
    return GE.overlapping(a.where("type <> 'Polygon'"), regions, cell=128.0)


@query("annotations_overlapping_polygon", "file:s region:s name:s",
       """select file, 'diamond' as region, name from (select file, name,
              least(120 * nx, 240 * nx + 100 * ny, 120 * nx + 200 * ny, 100 * ny) as lo1, greatest(120 * nx, 240 * nx + 100 * ny, 120 * nx + 200 * ny, 100 * ny) as hi1,
              least(xs[1] * nx + ys[1] * ny, xs[2] * nx + ys[2] * ny, xs[3] * nx + ys[3] * ny) as lo2,
              greatest(xs[1] * nx + ys[1] * ny, xs[2] * nx + ys[2] * ny, xs[3] * nx + ys[3] * ny) as hi2
            from (select *, unnest([ys[1] - ys[2], ys[2] - ys[3], ys[3] - ys[1], -5, 5]) as nx, unnest([xs[2] - xs[1], xs[3] - xs[2], xs[1] - xs[3], 6, 6]) as ny
                  from annos where type = 'Polygon'))
          group by file, name having bool_and(lo1 <= hi2 and lo2 <= hi1)""", "tiles", annos=ANNOS)
def _(spark, sf):
    """The exact polygon test: triangles against a diamond per file."""
    a = annos(spark, sf)
    regions = a.select("file").distinct().select("file", F.lit("diamond").alias("name"), F.array(*[
        F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((120, 0), (240, 100), (120, 200), (0, 100))]).alias("coords"))
    return GE.overlapping(a.where("type = 'Polygon'"), regions, cell=64.0)


_LAST, _MERGE = merged_boxes("boxes")


@query("boxes_merged", "file:s id:l row:d col:d h:d w:d", f"select file, id, y0 as row, x0 as col, y1 - y0 as h, x1 - x0 as w from {_LAST}", "tiles",
       boxes="""select name as file, vec_id as id, cast(j * 20 + vec_id % 17 as double) as x0, cast(i * 20 + vec_id % 13 as double) as y0,
              cast(j * 20 + vec_id % 17 + 8 + vec_id % 5 as double) as x1, cast(i * 20 + vec_id % 13 + 8 + vec_id % 9 as double) as y1 from tiles""", **_MERGE)
def _(spark, sf):
    """Overlapping boxes replaced by their hull until none overlap."""
    t = fx.tiles(spark, sf)
    boxes = t.select(F.col("name").alias("file"), F.col("vec_id").alias("id"), (F.col("i") * 20 + F.col("vec_id") % 13).alias("row"),
                     (F.col("j") * 20 + F.col("vec_id") % 17).alias("col"), (8 + F.col("vec_id") % 9).alias("h"), (8 + F.col("vec_id") % 5).alias("w"))
    return GE.merge_boxes(boxes)


@query("first_annotation_by_name", "file:s type:s color:s",
       """select file, arg_min(type, pos) as type, '#00000' || substr(arg_min("group", pos), 2, 1) as color from annos where type = 'Dot' group by file""", "tiles", annos=ANNOS)
def _(spark, sf):
    """First annotation of a name per file, colour inherited from its group."""
    a = annos(spark, sf).withColumn("name", F.when(F.col("type") == "Dot", "dot").otherwise("other"))
    return AN.first_by_name(AN.with_group_color(a, groups(spark, sf)), "dot")


@query("annotation_xml_parsed", "file:s name:s type:s group:s k:l x:d y:d",
       """select file, name, type, "group", k, round_even(x + 0.5e0, 0) as x, round_even(y + 0.25e0, 0) as y from pts""", "tiles", **PTS)
def _(spark, sf):
    """XML documents with decimal commas and unordered coordinates."""
    a = AN.shift(annos(spark, sf), 0.5, 0.25).withColumn("coords", F.transform("coords", lambda p: F.struct(
        F.replace(p["x"].cast("string"), F.lit("."), F.lit(",")).alias("x"), p["y"].cast("string").alias("y"))))
    docs = X.to_documents(a, groups(spark, sf))
    back = X.annotations_of(X.parse_documents(docs))
    return points(back)


@query("annotation_xml_round_trip", "part:s file:s name:s value:s",
       """select 'anno' as part, file, name, type || ' ' || cast(len(xs) as varchar) as value from annos union all select 'group', file, name, color from groups""",
       "tiles", annos=ANNOS, groups=GROUPS)
def _(spark, sf):
    """Written as one document per file, read back."""
    from bagframe.session import scratch_path

    path = scratch_path(spark, "annotations")
    X.write_annotations(annos(spark, sf), groups(spark, sf), path)
    a, g = X.read_written(spark, path)
    return a.select(F.lit("anno").alias("part"), "file", "name", F.concat_ws(" ", "type", F.size("coords").cast("string")).alias("value")).unionByName(
        g.select(F.lit("group").alias("part"), "file", "name", F.col("color").alias("value")))
