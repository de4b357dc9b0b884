"""bagframe: weakly labelled bag data (slides, tiles, scores, survival) on Spark DataFrames.

Every operator is a plain function ``f(df, ...) -> DataFrame`` or a ``Column`` expression. Nothing holds a
mutable table and nothing collects data to the driver except the few bounded facts named in a docstring
(class presence per category, Newton coefficients, convergence counters).
"""

__version__ = "0.1.0"
