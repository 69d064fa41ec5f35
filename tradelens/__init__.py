"""tradelens: marketplace sales metrics on Spark.

Raw marketplace datasets -> validation -> typed raw tables -> silver models ->
dimensions and facts -> seller / category / regional marts -> served metrics,
analyses and table tests.  Every step is a DataFrame function; nothing runs
until an action, and no Python UDF is on any path.
"""

__version__ = "0.1.0"
