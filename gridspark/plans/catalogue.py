"""One query for each operator over the test tables, and the SQL that gives the same rows.

The tables have no gridded fields; orders stand for a multi-year series (value: price, cell: the customer's nation),
line items for a larger one, events for a series within days, embeddings for a stack of dense 8 x 8 grids, nations and
suppliers for static layers and stations.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.functions import calendar
from gridspark.operators import clean, climatology, fields, mesh, normalize, sampling, tasks
from gridspark.operators.sampling import Sampling
from gridspark.plans import flow, joint_samples, lazy_placement as lazy, metrics, neighbours, placement, predictors, readout, runs
from gridspark.sources import tables
from gridspark.streaming import climatology as increments

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; they hold no NaN, as tables do that write_years has written."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    joined = orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
    return joined.select("o_orderkey", F.col("o_orderdate").alias("time"), F.col("c_nationkey").alias("cell_id"), F.col("o_totalprice").alias("value"))


SERIES = "s AS (SELECT o_orderkey, o_orderdate AS time, c_nationkey AS cell_id, o_totalprice AS value FROM orders JOIN customer ON o_custkey = c_custkey)"
MEAN = "CAST(SUM(CAST({0} AS DECIMAL(18,2))) AS DOUBLE) / COUNT({0})"


def static(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as an 5-column grid; the mask is regions 1 to 3."""
    n = F.col("n_nationkey")
    return read(spark, sf_dir, "nation").select(n.alias("cell_id"), F.expr("cast(n_nationkey div 5 as int)").alias("i_lat"), (n % 5).alias("i_lon"), (F.expr("n_nationkey div 5") * F.lit(10.0) + 40).alias("lat"), ((n % 5) * F.lit(10.0) - 90).alias("lon"), F.col("n_regionkey").between(1, 3).alias("mask"))


STATIC = "st AS (SELECT n_nationkey AS cell_id, CAST(n_nationkey // 5 AS INTEGER) AS i_lat, n_nationkey % 5 AS i_lon, (n_nationkey // 5) * 10.0::DOUBLE + 40 AS lat, (n_nationkey % 5) * 10.0::DOUBLE - 90 AS lon, n_regionkey BETWEEN 1 AND 3 AS mask FROM nation)"


@query(f"WITH {SERIES} SELECT dayofyear(time) AS doy, {MEAN.format('value')} AS clim FROM s GROUP BY 1")
def climatology_doy(spark, sf_dir):
    return climatology.climatology(series(spark, sf_dir), "value", scale=2)


@query(f"""WITH {SERIES}, c AS (SELECT dayofyear(time) AS doy, {MEAN.format('value')} AS clim FROM s GROUP BY 1)
SELECT o_orderkey, doy, value, clim, value - clim AS anom FROM s JOIN c ON dayofyear(s.time) = c.doy""")
def anomaly_doy(spark, sf_dir):
    return climatology.anomalies(series(spark, sf_dir), "value", scale=2).select("o_orderkey", "doy", "value", "clim", "anom")


@query(f"""WITH {SERIES}, c AS (SELECT dayofyear(time) AS doy, cell_id, {MEAN.format('value')} AS clim FROM s GROUP BY 1, 2)
SELECT o_orderkey, s.cell_id, value - clim AS anom FROM s JOIN c ON dayofyear(s.time) = c.doy AND s.cell_id = c.cell_id
WHERE time >= TIMESTAMP '1996-01-01' AND time < TIMESTAMP '1998-01-01'""")
def anomaly_by_cell_window(spark, sf_dir):
    return climatology.anomalies(series(spark, sf_dir), "value", ("cell_id",), start="1996-01-01", end="1997-12-31", scale=2).select("o_orderkey", "cell_id", "anom")


@query(f"""WITH {SERIES}, c AS (SELECT dayofyear(time) AS doy, {MEAN.format('value')} AS clim FROM s WHERE dayofyear(time) < 366 GROUP BY 1)
SELECT o_orderkey, value - clim AS anom FROM s LEFT JOIN c ON dayofyear(s.time) = c.doy""")
def climatology_preloaded_left(spark, sf_dir):
    s = series(spark, sf_dir)
    return climatology.anomalies(s, "value", clim=climatology.climatology(s, "value", scale=2).where("doy < 366")).select("o_orderkey", "anom")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0.05 THEN l_discount ELSE -0.009 END AS sst, CASE WHEN l_discount > 0.05 THEN l_tax ELSE -0.009 END AS other FROM lineitem""")
def fill_missing(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_discount") > 0.05, F.col("l_discount")).alias("sst"), F.col("l_tax").alias("other"))
    return clean.fill(df, "sst", ("other",))


@query("SELECT COUNT(*) AS n_rows, COUNT(value) AS n_values, COUNT(value) > 0 AS valid FROM events")
def validity_guard(spark, sf_dir):
    return clean.validity(read(spark, sf_dir, "events"), "value")


@query("SELECT event_id, CASE WHEN value IS NULL OR value < 1 THEN NULL WHEN value > 20 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS ice FROM events")
def ice_indicator(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", clean.ice_indicator(F.when(F.col("value") >= 1, F.col("value")), 20).alias("ice"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderdate < TIMESTAMP '1996-06-01'")
def time_slice(spark, sf_dir):
    return fields.time_slice(read(spark, sf_dir, "orders"), "1996-03-01", "1996-05-31", "o_orderdate").select("o_orderkey", "o_totalprice")


@query(f"WITH {STATIC} SELECT cell_id, lat, lon FROM st WHERE lat BETWEEN 50 AND 70 AND lon BETWEEN -80 AND -60")
def bbox_slice(spark, sf_dir):
    return fields.box(static(spark, sf_dir), (50, 70), (-80, -60)).select("cell_id", "lat", "lon")


@query("SELECT o_orderkey FROM orders WHERE dayofyear(o_orderdate) = 182")
def doy_select(spark, sf_dir):
    return fields.day_of_year(read(spark, sf_dir, "orders"), 182, "o_orderdate").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) % 5 = 0 AND o_orderdate >= TIMESTAMP '1995-01-01'")
def stride_dates(spark, sf_dir):
    return read(spark, sf_dir, "orders").where(calendar.every(F.col("o_orderdate"), "1995-01-01", 5) & (F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp_ntz"))).select("o_orderkey")


@query("SELECT CAST(CAST(d AS DATE) AS VARCHAR) AS date FROM range(DATE '2015-01-01', DATE '2017-01-01', INTERVAL 5 DAY) t(d)")
def date_range(spark, sf_dir):
    return calendar.dates(spark, "2015-01-01", "2016-12-31", 5).select(F.col("date").cast("string").alias("date"))


@query("SELECT CAST(MIN(o_orderdate) AS VARCHAR) AS first, CAST(MAX(o_orderdate) AS VARCHAR) AS last FROM orders")
def time_extent(spark, sf_dir):
    return read(spark, sf_dir, "orders").agg(F.min("o_orderdate").cast("string").alias("first"), F.max("o_orderdate").cast("string").alias("last"))


@query("""WITH b AS (SELECT ts FROM events ORDER BY abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15 12:00:00')), ts LIMIT 1)
SELECT event_id, value FROM events WHERE ts = (SELECT ts FROM b)""")
def nearest_time(spark, sf_dir):
    return fields.nearest_time(read(spark, sf_dir, "events"), "2024-01-15 12:00:00", "ts").select("event_id", "value")


@query(f"""WITH {STATIC}, a AS (SELECT lat FROM st ORDER BY abs(lat - 48.061), lat LIMIT 1), o AS (SELECT lon FROM st ORDER BY abs(lon + 87.793), lon LIMIT 1)
SELECT cell_id FROM st WHERE lat = (SELECT lat FROM a) AND lon = (SELECT lon FROM o)""")
def nearest_cell(spark, sf_dir):
    return fields.nearest_cell(static(spark, sf_dir), 48.061, -87.793).select("cell_id")


@query(f"WITH {STATIC} SELECT cell_id, i_lat, i_lon FROM st WHERE mask")
def lake_cells(spark, sf_dir):
    return fields.mask_cells(static(spark, sf_dir))


@query(f"WITH {STATIC}, {SERIES} SELECT o_orderkey, cell_id FROM s WHERE cell_id IN (SELECT cell_id FROM st WHERE mask)")
def masked_candidates(spark, sf_dir):
    return fields.within(series(spark, sf_dir), fields.mask_cells(static(spark, sf_dir))).select("o_orderkey", "cell_id")


@query("SELECT event_id, cos(2 * pi() * dayofyear(ts) / 365.25) AS cos_d, sin(2 * pi() * dayofyear(ts) / 365.25) AS sin_d FROM events")
def cyclic_time(spark, sf_dir):
    cos, sin = calendar.cyclic(F.col("ts"))
    return read(spark, sf_dir, "events").select("event_id", cos.alias("cos_d"), sin.alias("sin_d"))


@query("SELECT event_id, floor(epoch_us(ts) / 86400e6 + 40587)::BIGINT AS mjd_day, TRUE AS same FROM events")
def mjd_roundtrip(spark, sf_dir):
    """A day number as a double is good to about a microsecond."""
    mjd = calendar.to_mjd(F.col("ts"))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    back = F.abs(micros(calendar.from_mjd(mjd)) - micros(F.col("ts"))) <= 2
    return read(spark, sf_dir, "events").select("event_id", F.floor(mjd).alias("mjd_day"), back.alias("same"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 360 > 180 THEN s_suppkey % 360 - 360 ELSE s_suppkey % 360 END AS lon FROM supplier")
def longitude_wrap(spark, sf_dir):
    return mesh.nodes(read(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 360).alias("lon")))


@query("SELECT p_partkey, [p_size - 1, p_size, p_size + 1][2] AS corner, p_size - 1 AS first FROM part")
def mesh_triangles(spark, sf_dir):
    nv = read(spark, sf_dir, "part").select("p_partkey", F.array(F.col("p_size"), F.col("p_size") + 1, F.col("p_size") + 2).alias("nv"))
    return mesh.triangles(nv).select("p_partkey", F.col("nv")[1].alias("corner"), F.col("nv")[0].alias("first"))


def _fit_sql(where: str) -> str:
    return f"""SELECT 'o_totalprice' AS var_id, 'mean_std' AS method, round(avg(o_totalprice), 5) AS p1, round(stddev_pop(o_totalprice), 5) AS p2 FROM orders {where}"""


def _rounded(fitted: DataFrame) -> DataFrame:
    return fitted.select("var_id", "method", F.round("p1", 5).alias("p1"), F.round("p2", 5).alias("p2"))


@query(_fit_sql(""))
def norm_fit(spark, sf_dir):
    return _rounded(normalize.fit(read(spark, sf_dir, "orders"), ("o_totalprice",)))


@query(_fit_sql("WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1995-04-02'"))
def norm_subset_fit(spark, sf_dir):
    return _rounded(normalize.fit(fields.time_slice(read(spark, sf_dir, "orders"), "1995-01-01", "1995-04-01", "o_orderdate"), ("o_totalprice",)))


@query("""WITH m AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders)
SELECT o_orderkey, (o_totalprice - (a + b) / 2) / ((b - a) / 2) AS o_totalprice FROM orders, m""")
def norm_minmax(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return normalize.apply(orders, normalize.params(normalize.fit(orders, ("o_totalprice",), "min_max")))


@query("SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders")
def norm_roundtrip(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    fitted = normalize.params(normalize.fit(orders, ("o_totalprice",)))
    return normalize.apply(normalize.apply(orders, fitted), fitted, back=True).withColumn("o_totalprice", F.round("o_totalprice", 2))


def _daily(spark, sf_dir) -> DataFrame:
    events = read(spark, sf_dir, "events")
    return events.select(F.to_date("ts").alias("date"), F.col("event_id").alias("cell_id"), (F.col("user_id") % 10).cast("double").alias("x1"), (F.col("user_id") % 7).cast("double").alias("x2"), F.col("value").alias("y"))


DAILY = "d AS (SELECT CAST(ts AS DATE) AS date, event_id AS cell_id, CAST(user_id % 10 AS DOUBLE) AS x1, CAST(user_id % 7 AS DOUBLE) AS x2, value AS y FROM events)"


@query(f"""WITH {DAILY} SELECT CAST(date AS VARCHAR) AS date, cell_id FROM d
QUALIFY row_number() OVER (PARTITION BY date ORDER BY md5(cell_id || ':42:' || date), cell_id) <= 20""")
def sample_context(spark, sf_dir):
    return sampling.sample(_daily(spark, sf_dir), Sampling(n=20, seed=42)).select(F.col("date").cast("string").alias("date"), "cell_id")


@query(f"""WITH {SERIES}, y AS (SELECT DISTINCT year(time) AS date, cell_id FROM s) SELECT date, cell_id FROM y
QUALIFY row_number() OVER (PARTITION BY date ORDER BY md5(cell_id || ':7'), cell_id) <= 6""")
def sample_fixed_seed(spark, sf_dir):
    cells = series(spark, sf_dir).select(F.year("time").cast("long").alias("date"), "cell_id").distinct()
    return sampling.sample(cells, Sampling(n=6, seed=7, fixed=True))


@query(f"""WITH {DAILY}, t AS (SELECT DISTINCT date FROM d)
SELECT CAST(date AS VARCHAR) AS date, CAST(5 + CAST('0x' || substr(md5(date || ':n:3'), 1, 8) AS BIGINT) % 15 AS INTEGER) AS n FROM t""")
def context_counts(spark, sf_dir):
    return _daily(spark, sf_dir).select("date").distinct().select(F.col("date").cast("string").alias("date"), sampling.draws(F.col("date"), 5, 20, 3).alias("n"))


@query(f"""WITH {DAILY}, {STATIC}, t AS (SELECT DISTINCT date FROM d WHERE date_diff('day', DATE '2024-01-01', date) % 5 = 0),
c AS (SELECT d.* FROM d SEMI JOIN t USING (date) QUALIFY row_number() OVER (PARTITION BY date ORDER BY md5(cell_id || ':1:' || date), cell_id) <= 10)
SELECT CAST(date AS VARCHAR) AS date, 'context' AS role, 0 AS set_idx, cell_id, x1, x2, y FROM c
UNION ALL SELECT CAST(date AS VARCHAR), 'context', 1, CAST(cell_id AS BIGINT), lat, lon, CAST(mask AS INTEGER)::DOUBLE FROM t, st
UNION ALL SELECT CAST(date AS VARCHAR), 'target', 0, cell_id, x1, x2, y FROM d SEMI JOIN t USING (date)""")
def task_points(spark, sf_dir):
    daily = _daily(spark, sf_dir)
    dates = daily.select("date").distinct().where(calendar.every(F.col("date"), "2024-01-01", 5))
    layer = static(spark, sf_dir).select(F.col("cell_id").cast("long").alias("cell_id"), F.col("lat").alias("x1"), F.col("lon").alias("x2"), F.col("mask").cast("double").alias("y"))
    built = tasks.build([(daily, Sampling(n=10, seed=1)), (layer, Sampling())], (daily, Sampling()), dates)
    return built.withColumn("date", F.col("date").cast("string"))


@query("""WITH x AS (SELECT vec_id, unnest(embedding) AS value, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings)
SELECT vec_id, CAST(k AS INTEGER) AS cell_id, CAST(k // 8 AS INTEGER) AS i_lat, CAST(k % 8 AS INTEGER) AS i_lon, CAST(value AS DOUBLE) AS value FROM x""")
def grid_explode(spark, sf_dir):
    return fields.grid_of(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "embedding", 8, "vec_id")


@query("""SELECT round(sqrt(avg((l_quantity - 25) * (l_quantity - 25))), 8) AS rmse, COUNT(*) AS n, CAST(0 AS BIGINT) AS n_null FROM lineitem""")
def rmse_pooled(spark, sf_dir):
    found = metrics.rmse_of(read(spark, sf_dir, "lineitem"), F.lit(25.0), F.col("l_quantity"))
    return found.withColumn("rmse", F.round("rmse", 8))


@query("""SELECT l_suppkey, round(sqrt(avg((l_quantity - 25) * (l_quantity - 25))), 8) AS rmse, COUNT(*) AS n, CAST(0 AS BIGINT) AS n_null FROM lineitem GROUP BY 1""")
def rmse_by_task(spark, sf_dir):
    found = metrics.rmse_of(read(spark, sf_dir, "lineitem"), F.lit(25.0), F.col("l_quantity"), ["l_suppkey"])
    return found.withColumn("rmse", F.round("rmse", 8))


@query("SELECT CAST(o_orderkey % 25 AS BIGINT) AS epoch, round(avg(o_totalprice), 5) AS loss FROM orders GROUP BY 1")
def epoch_loss(spark, sf_dir):
    losses = read(spark, sf_dir, "orders").select((F.col("o_orderkey") % 25).alias("epoch"), F.col("o_totalprice").alias("loss"))
    return metrics.epoch_loss(losses).withColumn("loss", F.round("loss", 5))


@query("""WITH r AS (SELECT s_suppkey AS epoch, s_acctbal AS rmse FROM supplier),
w AS (SELECT *, min(rmse) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r)
SELECT epoch, rmse, rmse < coalesce(before, 'inf'::DOUBLE) AS is_best FROM w""")
def best_so_far(spark, sf_dir):
    return metrics.best_so_far(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("epoch"), F.col("s_acctbal").alias("rmse")))


def _grid_targets(spark, sf_dir) -> DataFrame:
    return static(spark, sf_dir).select(F.col("cell_id").alias("target_id"), ((F.col("lat") - 40) / 5).alias("x1"), ((F.col("lon") + 90) / 5).alias("x2"))


def _kernel_sql(targets: str, context: str = "SELECT * FROM d") -> str:
    return f"""WITH {DAILY}, {STATIC}, c AS ({context}), t AS ({targets}),
p AS (SELECT date, target_id, y, power(c.x1 - t.x1, 2) + power(c.x2 - t.x2, 2) AS d2 FROM c, t)
SELECT CAST(date AS VARCHAR) AS date, target_id, round(sum(exp(-d2 / 4.5) * y) / sum(exp(-d2 / 4.5)), 6) AS mean, round(sum(exp(-d2 / 4.5)), 6) AS density FROM p GROUP BY 1, 2"""


def _kernel(found: DataFrame) -> DataFrame:
    return found.select(F.col("date").cast("string").alias("date"), "target_id", F.round("mean", 6).alias("mean"), F.round("density", 6).alias("density"))


GRID = "SELECT cell_id AS target_id, (lat - 40) / 5 AS x1, (lon + 90) / 5 AS x2 FROM st"
POINTS = "SELECT 0 AS target_id, 4.2::DOUBLE AS x1, 3.3::DOUBLE AS x2 UNION ALL SELECT 1, 8.6::DOUBLE, 1.1::DOUBLE"


def _points(spark) -> DataFrame:
    return spark.createDataFrame([(0, 4.2, 3.3), (1, 8.6, 1.1)], "target_id int, x1 double, x2 double")


@query(_kernel_sql(GRID))
def setconv_predict(spark, sf_dir):
    """All events of a date as context; weights beyond 8 lengths (under 2e-14) are left out."""
    return _kernel(predictors.setconv(_daily(spark, sf_dir), _grid_targets(spark, sf_dir), 1.5, reach=12.0, every=True))


@query(_kernel_sql(POINTS))
def setconv_offgrid(spark, sf_dir):
    return _kernel(predictors.setconv(_daily(spark, sf_dir), _points(spark), 1.5))


@query(_kernel_sql(POINTS, "SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY date ORDER BY md5(cell_id || ':5:' || date), cell_id) <= 50"))
def setconv_sampled(spark, sf_dir):
    """A sampled context, as tasks have: 50 events of each date."""
    return _kernel(predictors.setconv(sampling.sample(_daily(spark, sf_dir), Sampling(n=50, seed=5)), _points(spark), 1.5))


@query("SELECT user_id % 10 AS cell_id, round(avg(d), 6) AS score FROM (SELECT user_id, CAST(ts AS DATE) AS date, sqrt(value) AS d FROM events) GROUP BY 1")
def acquisition_mean(spark, sf_dir):
    std = read(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("cell_id"), F.sqrt("value").alias("std"))
    return placement.acquisition(std).withColumn("score", F.round("score", 6))


@query("SELECT o_orderkey, year(o_orderdate)::INTEGER AS year FROM orders WHERE year(o_orderdate) IN (1996, 1997)")
def years_concat(spark, sf_dir):
    """Yearly frames put together, the last year left out."""
    orders = read(spark, sf_dir, "orders")
    each = [fields.time_slice(orders, f"{y}-01-01", f"{y}-12-31", "o_orderdate").withColumn("year", F.lit(y)) for y in tables.years(1996, 1998)]
    return tables.concat(each).select("o_orderkey", "year")


@query("SELECT CAST(o_orderdate AS VARCHAR) AS time, o_custkey, COUNT(*) AS n FROM orders GROUP BY 1, 2 HAVING COUNT(*) > 1")
def repeated_coordinates(spark, sf_dir):
    return tables.repeated_keys(read(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("string").alias("time"), "o_custkey"), "time", "o_custkey")


@query(None)
def gp_predict(spark, sf_dir):
    context = sampling.sample(_daily(spark, sf_dir), Sampling(n=60, seed=9))
    return predictors.gp_predict(context, _grid_targets(spark, sf_dir), 1.5).withColumn("date", F.col("date").cast("string"))


@query(None)
def gp_samples(spark, sf_dir):
    context = sampling.sample(_daily(spark, sf_dir), Sampling(n=60, seed=9))
    return predictors.gp_predict(context, _grid_targets(spark, sf_dir), 1.5, samples=3).withColumn("date", F.col("date").cast("string"))


@query(None)
def field_samples(spark, sf_dir):
    """Three fields over all cells of each date given all of its events, drawn tile by tile."""
    context = _daily(spark, sf_dir)
    wanted = context.select("date").distinct().crossJoin(_grid_targets(spark, sf_dir))
    return joint_samples.sample_fields(context, wanted, 1.5, samples=3).withColumn("date", F.col("date").cast("string"))


@query(None)
def greedy_placement(spark, sf_dir):
    context = sampling.sample(_daily(spark, sf_dir), Sampling(n=30, seed=0, fixed=True))
    cells = _grid_targets(spark, sf_dir).withColumnRenamed("target_id", "cell_id")
    return placement.greedy(context, fields.within(cells, fields.mask_cells(static(spark, sf_dir))), cells, 3, 1.5)[0]


TWO = "c AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY x1, x2, y) AS k FROM (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY date ORDER BY md5(cell_id || ':9:' || date), cell_id) <= 2))"


@query(f"""WITH {DAILY}, {STATIC}, {TWO}, t AS ({GRID}), e AS (SELECT 1.01 + 1e-10 AS a),
p AS (SELECT u.date, u.x1 AS u1, u.x2 AS u2, u.y AS uy, v.x1 AS v1, v.x2 AS v2, v.y AS vy FROM c u JOIN c v ON u.date = v.date WHERE u.k = 1 AND v.k = 2),
q AS (SELECT date, target_id, uy, vy, exp(-(power(u1 - v1, 2) + power(u2 - v2, 2)) / 4.5) AS r, exp(-(power(u1 - x1, 2) + power(u2 - x2, 2)) / 4.5) AS f, exp(-(power(v1 - x1, 2) + power(v2 - x2, 2)) / 4.5) AS g FROM p, t)
SELECT CAST(date AS VARCHAR) AS date, target_id, round((f * (a * uy - r * vy) + g * (a * vy - r * uy)) / (a * a - r * r), 5) AS mean,
round(sqrt(greatest(1 - (a * f * f - 2 * r * f * g + a * g * g) / (a * a - r * r), 0)), 5) AS std FROM q, e""")
def gp_two_points(spark, sf_dir):
    """The Gaussian process in closed form: two context points a date."""
    found = predictors.gp_predict(sampling.sample(_daily(spark, sf_dir), Sampling(n=2, seed=9)), _grid_targets(spark, sf_dir), 1.5)
    return found.select(F.col("date").cast("string").alias("date"), "target_id", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"))


ONE = f"""{DAILY}, {STATIC}, c AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY date ORDER BY md5(cell_id || ':0'), cell_id) <= 1),
t AS ({GRID}), a AS (SELECT target_id AS cell_id, x1, x2 FROM t JOIN st ON target_id = st.cell_id WHERE mask),
k AS (SELECT date, target_id, a.cell_id, exp(-(power(c.x1 - t.x1, 2) + power(c.x2 - t.x2, 2)) / 4.5) AS tx, exp(-(power(c.x1 - a.x1, 2) + power(c.x2 - a.x2, 2)) / 4.5) AS ax, exp(-(power(t.x1 - a.x1, 2) + power(t.x2 - a.x2, 2)) / 4.5) AS ta FROM c, t, a),
s AS (SELECT cell_id, avg(sqrt(greatest(1 - tx * tx / 1.01 - power(ta - tx * ax / 1.01, 2) / (1.01 - ax * ax / 1.01), 0))) AS score FROM k GROUP BY 1)"""


def _placed(spark, sf_dir, n: int) -> tuple[DataFrame, DataFrame]:
    context = sampling.sample(_daily(spark, sf_dir), Sampling(n=1, seed=0, fixed=True))
    cells = _grid_targets(spark, sf_dir).withColumnRenamed("target_id", "cell_id")
    return placement.greedy(context, fields.within(cells, fields.mask_cells(static(spark, sf_dir))), cells, n, 1.5)


@query(f"WITH {ONE} SELECT 1 AS iteration, CAST(cell_id AS BIGINT) AS cell_id, round(score, 8) AS score FROM s")
def candidate_scores(spark, sf_dir):
    """Every candidate met with every task: the deviation left, in closed form for one context point."""
    return _placed(spark, sf_dir, 1)[1].withColumn("score", F.round("score", 8))


@query(f"WITH {ONE} SELECT 1 AS iteration, CAST(s.cell_id AS BIGINT) AS cell_id, x1, x2, round(score, 8) AS score FROM s JOIN a ON s.cell_id = a.cell_id ORDER BY round(score, 12), s.cell_id LIMIT 1")
def first_placement(spark, sf_dir):
    return _placed(spark, sf_dir, 1)[0].withColumn("score", F.round("score", 8))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate = TIMESTAMP '1996-03-01'")
def exact_time(spark, sf_dir):
    return fields.exact_time(read(spark, sf_dir, "orders"), "1996-03-01 00:00:00", "o_orderdate").select("o_orderkey", "o_totalprice")


@query("SELECT s_suppkey AS station, s_acctbal AS depth FROM supplier")
def rename_columns(spark, sf_dir):
    return fields.rename(read(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), {"s_suppkey": "station", "s_acctbal": "depth"})


@query("SELECT n_nationkey, n_name FROM nation")
def drop_columns(spark, sf_dir):
    """Strictly one that is there, leniently one that is not."""
    return fields.drop_strict(read(spark, sf_dir, "nation"), "n_regionkey").drop("crs")


@query("SELECT event_id, value FROM events")
def squeeze_dimension(spark, sf_dir):
    """A dimension of one value goes."""
    return fields.squeeze(read(spark, sf_dir, "events").select("event_id", "value", F.lit(1).alias("siglay")), "siglay")


@query("SELECT event_id, nullif(trim(CASE WHEN event_type = 'click' THEN '  ' ELSE event_type END), '') AS kind FROM events")
def empty_to_null(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "  ").otherwise(F.col("event_type"))
    return read(spark, sf_dir, "events").select("event_id", clean.empty_to_null(kind).alias("kind"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS text, date_trunc('minute', ts) = strptime(strftime(ts, '%Y-%m-%d %H:%M'), '%Y-%m-%d %H:%M') AS same FROM events")
def parse_and_format(spark, sf_dir):
    text = calendar.format_date(F.col("ts"), "yyyy-MM-dd HH:mm")
    return read(spark, sf_dir, "events").select("event_id", text.alias("text"), (F.date_trunc("minute", "ts").cast("timestamp_ntz") == calendar.parse(text, "yyyy-MM-dd HH:mm")).alias("same"))


@query("SELECT event_id, CASE WHEN value > 20 THEN 20.0::DOUBLE ELSE value END AS value FROM events")
def user_function(spark, sf_dir):
    return clean.apply_function(read(spark, sf_dir, "events").select("event_id", "value"), "value", lambda v: v.clip(upper=20.0))


@query(f"WITH {DAILY} SELECT DISTINCT CAST(date AS VARCHAR) AS date, 20 AS n FROM d")
def equal_bounds(spark, sf_dir):
    """A range whose ends are equal is that number."""
    return _daily(spark, sf_dir).select("date").distinct().select(F.col("date").cast("string").alias("date"), sampling.draws(F.col("date"), 20, 20, 3).alias("n"))


@query(f"WITH {STATIC}, {DAILY}, t AS (SELECT DISTINCT date FROM d) SELECT cell_id, CAST(date AS VARCHAR) AS date, cos(2 * pi() * dayofyear(date) / 365.25) AS cos_d FROM st, t")
def time_on_cells(spark, sf_dir):
    """A series without place under each cell of a layer without time."""
    times = _daily(spark, sf_dir).select("date").distinct().withColumn("cos_d", calendar.cyclic(F.col("date"))[0])
    return tasks.attach_times(static(spark, sf_dir).select("cell_id"), times).withColumn("date", F.col("date").cast("string"))


@query(f"WITH {STATIC}, m AS (SELECT min(lat) AS a, max(lat) AS b, min(lon) AS c, max(lon) AS d FROM st) SELECT cell_id, (lat - a) / (b - a) AS x1, (lon - c) / (d - c) AS x2 FROM st, m")
def coordinates_in_model_space(spark, sf_dir):
    cells = static(spark, sf_dir)
    fitted = normalize.params(normalize.fit(cells, ("lat", "lon"), "unit"))
    return normalize.apply(cells, fitted).select("cell_id", F.col("lat").alias("x1"), F.col("lon").alias("x2"))


@query("""WITH p AS (SELECT CAST(ts AS DATE) AS date, user_id % 10 AS cell, avg(value) AS y FROM events GROUP BY 1, 2), m AS (SELECT user_id % 10 AS cell, avg(value) AS mean FROM events GROUP BY 1)
SELECT round(sqrt(avg(power(mean - y, 2))), 8) AS rmse, COUNT(*) AS n, CAST(0 AS BIGINT) AS n_null FROM p JOIN m ON p.cell = m.cell""")
def rmse_joined(spark, sf_dir):
    """Predictions (each cell's mean) against the truth of every task, joined on task and cell."""
    events = read(spark, sf_dir, "events").select(F.to_date("ts").alias("date"), (F.col("user_id") % 10).alias("cell"), "value")
    truth = events.groupBy("date", "cell").agg(F.avg("value").alias("y"))
    pred = truth.select("date", "cell").join(events.groupBy("cell").agg(F.avg("value").alias("mean")), "cell")
    return metrics.rmse(pred, truth, ["date", "cell"]).withColumn("rmse", F.round("rmse", 8))


@query("""WITH x AS (SELECT o_orderdate AS date, o_orderkey, o_totalprice AS y FROM orders), t AS (SELECT DISTINCT date FROM x),
s AS (SELECT date FROM t ORDER BY md5(CAST(strftime(date, '%Y-%m-%d') AS VARCHAR) || ':4'), date LIMIT 50), m AS (SELECT avg(o_totalprice) AS mean FROM orders)
SELECT round(sqrt(avg(power(mean - y, 2))), 5) AS rmse, COUNT(*) AS n, CAST(0 AS BIGINT) AS n_null FROM x SEMI JOIN s USING (date), m""")
def rmse_of_50_tasks(spark, sf_dir):
    truth = read(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date"), "o_orderkey", F.col("o_totalprice").alias("y"))
    pred = truth.select("date", "o_orderkey").crossJoin(F.broadcast(truth.agg(F.avg("y").alias("mean"))))  # one row
    return metrics.rmse_of_tasks(pred, truth, ["date", "o_orderkey"], 50, 4).withColumn("rmse", F.round("rmse", 5))


@query(f"""WITH {SERIES}, f AS (SELECT time, cell_id, CASE WHEN value > 100000 THEN value ELSE -0.009 END AS value FROM s),
c AS (SELECT dayofyear(time) AS doy, CAST(SUM(CAST(value AS DECIMAL(18,3))) AS DOUBLE) / COUNT(value) AS clim FROM f GROUP BY 1) SELECT doy, clim FROM c""")
def climatology_filled(spark, sf_dir):
    """Days without a value count with the fill value, which has three decimals."""
    s = series(spark, sf_dir).select("time", "cell_id", F.when(F.col("value") > 100000, F.col("value")).alias("value"))
    return climatology.climatology(clean.fill(s, "value"), "value", scale=3)


@query(f"""WITH {DAILY}, {STATIC}, t AS (SELECT DISTINCT date FROM d WHERE date_diff('day', DATE '2024-01-01', date) % 5 = 0), m AS (SELECT * FROM d SEMI JOIN t USING (date) WHERE cell_id % 3 = 0),
c AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY date ORDER BY md5(cell_id || ':1:' || date), cell_id) <= 10)
SELECT CAST(date AS VARCHAR) AS date, 'context' AS role, 0 AS set_idx, cell_id, x1, x2, y FROM c
UNION ALL SELECT NULL, 'context', 1, CAST(cell_id AS BIGINT), lat, lon, CAST(mask AS INTEGER)::DOUBLE FROM st""")
def task_points_masked(spark, sf_dir):
    """Context from the cells of a mask alone, a layer kept once, and no target: tasks to predict with."""
    daily = _daily(spark, sf_dir)
    dates = daily.select("date").distinct().where(calendar.every(F.col("date"), "2024-01-01", 5))
    layer = static(spark, sf_dir).select(F.col("cell_id").cast("long").alias("cell_id"), F.col("lat").alias("x1"), F.col("lon").alias("x2"), F.col("mask").cast("double").alias("y"))
    mask = daily.where("cell_id % 3 = 0").select("cell_id")
    built = tasks.build([(daily, Sampling(n=10, seed=1)), (layer, Sampling())], None, dates, mask, repeat_static=False)
    return built.withColumn("date", F.col("date").cast("string"))


@query("SELECT p_partkey, p_retailprice AS mn, CAST(NULL AS DOUBLE) AS sd FROM part")
def export_names(spark, sf_dir):
    pred = read(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("mean"), F.lit(None).cast("double").alias("std"))
    return runs.predictions_for_export(pred)


def _lazy_sql(picks: int) -> str:
    """Picks one by one: p0 covariances of targets and candidates given one context point, each pick a rank-one term."""
    steps = ["""p0 AS (SELECT k.date, k.target_id AS i, k.cell_id AS j, ta - tx * ax / 1.01 AS cov, 1 - tx * tx / 1.01 AS vi, 1.01 - ax * ax / 1.01 AS vj FROM k)"""]
    for n in range(1, picks + 1):
        taken = "".join(f" AND j <> (SELECT cell_id FROM s{m})" for m in range(1, n))
        steps.append(f"s{n} AS (SELECT {n} AS iteration, j AS cell_id, avg(sqrt(greatest(vi - cov * cov / vj, 0))) AS score FROM p{n - 1} WHERE true{taken} GROUP BY j ORDER BY round(score, 12), j LIMIT 1)")
        steps.append(f"""p{n} AS (SELECT p.date, p.i, p.j, p.cov - a.cov * b.cov / a.vj AS cov, p.vi - a.cov * a.cov / a.vj AS vi, p.vj - b.cov * b.cov / a.vj AS vj
FROM p{n - 1} p JOIN p{n - 1} a ON a.date = p.date AND a.i = p.i AND a.j = (SELECT cell_id FROM s{n}) JOIN p{n - 1} b ON b.date = p.date AND b.i = p.j AND b.j = a.j)""")
    chosen = " UNION ALL ".join(f"SELECT * FROM s{n}" for n in range(1, picks + 1))
    one = ONE[: ONE.rindex("\ns AS (")]
    return f"WITH {one}\n{', '.join(steps)} SELECT iteration, CAST(q.cell_id AS BIGINT) AS cell_id, x1, x2, round(score, 8) AS score FROM ({chosen}) q JOIN a ON q.cell_id = a.cell_id"


@query(_lazy_sql(3))
def lazy_placement(spark, sf_dir):
    """Three picks, candidates scored again only while their bounds could win."""
    context = sampling.sample(_daily(spark, sf_dir), Sampling(n=1, seed=0, fixed=True))
    cells = _grid_targets(spark, sf_dir).withColumn("cell_id", F.col("target_id").cast("long"))
    found = lazy.lazy_greedy(context, fields.within(cells, fields.mask_cells(static(spark, sf_dir))), cells, 3, 1.5)[0]
    return found.withColumn("score", F.round("score", 8))


# The flow: daily means of the orders of a nation are the series, anomalies from 1996 on, epochs of kernel predictors.
LENGTHS = (0.1, 0.3, 0.2)
FLOW = f"""{STATIC}, {SERIES}, g AS (SELECT CAST(time AS DATE) AS date, cell_id, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / COUNT(value) AS v FROM s GROUP BY 1, 2),
cl AS (SELECT dayofyear(date) AS doy, cell_id, avg(v) AS clim FROM g GROUP BY 1, 2),
an AS (SELECT date, g.cell_id, v - clim AS a FROM g JOIN cl ON dayofyear(date) = doy AND g.cell_id = cl.cell_id WHERE date >= DATE '1996-01-01' AND date <= DATE '1999-12-31'),
mm AS (SELECT avg(a) AS mu, stddev_pop(a) AS sd FROM an), bx AS (SELECT min(lat) AS la, max(lat) AS lb, min(lon) AS lc, max(lon) AS ld FROM st),
ce AS (SELECT cell_id, (lat - la) / (lb - la) AS x1, (lon - lc) / (ld - lc) AS x2 FROM st, bx),
ser AS (SELECT date, an.cell_id, x1, x2, (a - mu) / sd AS y FROM an JOIN ce ON an.cell_id = ce.cell_id, mm)"""


def _flow(spark, sf_dir) -> flow.Flow:
    s = series(spark, sf_dir)
    daily = s.groupBy(F.date_trunc("day", "time").cast("timestamp_ntz").alias("time"), "cell_id").agg(climatology.exact_mean(F.col("value"), 2).alias("value"))
    return flow.Flow(spark, static(spark, sf_dir), "value", ("mask",)).load(daily, anomaly_start="1996-01-01", anomaly_end="1999-12-31")


def _epoch_sql(k: int, length: float) -> str:
    """Loss and error of one epoch; contexts hold 1 to 4 cells of a date."""
    task = lambda days, seed: f"""(SELECT ser.* FROM ser WHERE {days} QUALIFY row_number() OVER (PARTITION BY date ORDER BY md5(cell_id || ':{seed}:' || date), cell_id) <= 1 + CAST('0x' || substr(md5(date || ':n:{seed}'), 1, 8) AS BIGINT) % 4)"""
    stride = lambda start, end: f"date >= DATE '{start}' AND date <= DATE '{end}' AND date_diff('day', DATE '{start}', date) % 5 = 0"
    train, val = stride("1996-01-01", "1997-12-31"), stride("1998-01-01", "1998-12-31")
    kernel = lambda days, seed: f"""(SELECT c.date, ce.cell_id, sum(w * c.y) / sum(w) AS m FROM (SELECT c.date, c.y, ce.cell_id, exp(-(power(c.x1 - ce.x1, 2) + power(c.x2 - ce.x2, 2)) / (2 * {length} * {length})) AS w FROM {task(days, seed)} c, ce) c JOIN ce ON c.cell_id = ce.cell_id GROUP BY 1, 2)"""
    return f"""SELECT {k} AS epoch,
(SELECT round(avg(l), 6) FROM (SELECT p.date, avg(power(m - y, 2)) AS l FROM {kernel(train, k)} p JOIN ser ON p.date = ser.date AND p.cell_id = ser.cell_id GROUP BY 1)) AS loss,
(SELECT round(sqrt(avg(power((m - y) * sd, 2))), 4) FROM {kernel(val, 0)} p JOIN ser ON p.date = ser.date AND p.cell_id = ser.cell_id, mm) AS val_rmse"""


@query(f"""WITH {FLOW}, e AS ({" UNION ALL ".join(_epoch_sql(k, length) for k, length in enumerate(LENGTHS, 1))}),
w AS (SELECT *, min(val_rmse) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e)
SELECT epoch, loss, val_rmse, val_rmse < coalesce(before, 'inf'::DOUBLE) AS is_best FROM w""")
def train_metrics(spark, sf_dir):
    """Load, anomalies, tasks, epochs with contexts drawn anew, and the error on fixed validation tasks."""
    found = _flow(spark, sf_dir).train(None, flow.lengths(list(LENGTHS), 15.0), ("1996-01-01", "1997-12-31"), ("1998-01-01", "1998-12-31"), 5, (1, 5))
    return found.select("epoch", F.round("loss", 6).alias("loss"), F.round("val_rmse", 4).alias("val_rmse"), "is_best")


@query(f"""WITH {FLOW}, q AS (SELECT 0 AS target_id, 48.0::DOUBLE AS lat, -72.5::DOUBLE AS lon UNION ALL SELECT 1, 66.0, -55.0),
tq AS (SELECT target_id, lat, lon, (lat - la) / (lb - la) AS x1, (lon - lc) / (ld - lc) AS x2 FROM q, bx)
SELECT CAST(date AS VARCHAR) AS date, target_id, lat, lon, round(sum(w * y) / sum(w) * sd + mu, 4) AS mean
FROM (SELECT date, y, target_id, lat, lon, exp(-(power(ser.x1 - tq.x1, 2) + power(ser.x2 - tq.x2, 2)) / (2 * 0.3 * 0.3)) AS w FROM ser, tq WHERE date >= DATE '1999-01-01' AND date <= DATE '1999-05-20'), mm GROUP BY date, target_id, lat, lon, sd, mu""")
def predict_stations(spark, sf_dir):
    """Predictions at stations off the grid, in units of the series, from all cells of each date."""
    run = _flow(spark, sf_dir)
    stations = spark.createDataFrame([(0, 48.0, -72.5), (1, 66.0, -55.0)], "target_id int, lat double, lon double")
    found = run.predict(predictors.SetConv(0.3), run.dates("1999-01-01", "1999-05-20"), stations)
    return found.select(F.col("date").cast("string").alias("date"), "target_id", "lat", "lon", F.round("mean", 4).alias("mean"))


def _days_sql(start: str, end: str) -> str:
    return f"date >= DATE '{start}' AND date <= DATE '{end}' AND date_diff('day', DATE '{start}', date) % 5 = 0"


TRAIN, VAL = ("1996-01-01", "1997-12-31"), ("1998-01-01", "1998-12-31")


def _met_sql(days: str, seed: int, low: int, high: int, kernel: str, l1: str, l2: str) -> str:
    """Sums at every target of every task, with derivatives by the logarithms of the lengths; kernel: a row with them."""
    return f"""(SELECT date, cell_id, any_value(y) AS y, coalesce(sum(w * cy), 0) AS s, coalesce(sum(w), 0) AS d, coalesce(sum(w * q1 * cy), 0) AS s1, coalesce(sum(w * q1), 0) AS d1, coalesce(sum(w * q2 * cy), 0) AS s2, coalesce(sum(w * q2), 0) AS d2
FROM (SELECT *, exp(-(q1 + q2) / 2) AS w FROM (SELECT t.date, t.cell_id, t.y, c.y AS cy, power((c.x1 - t.x1) / {l1}, 2) AS q1, power((c.x2 - t.x2) / {l2}, 2) AS q2
FROM (SELECT * FROM ser WHERE {days}) t LEFT JOIN (SELECT ser.* FROM ser WHERE {days} QUALIFY row_number() OVER (PARTITION BY date ORDER BY md5(cell_id || ':{seed}:' || date), cell_id) <= {low} + CAST('0x' || substr(md5(date || ':n:{seed}'), 1, 8) AS BIGINT) % {high - low}) c ON t.date = c.date, {kernel}))
GROUP BY 1, 2)"""


@query(f"""WITH {FLOW}, k AS (SELECT 0.3 AS l) SELECT round(sqrt(avg(power(((CASE WHEN d > 0 THEN s / d ELSE 0 END) - y) * sd, 2))), 4) AS rmse, COUNT(*) AS n, CAST(0 AS BIGINT) AS n_null
FROM {_met_sql(_days_sql(*VAL), 0, 0, 3, "k", "l", "l")}, mm""")
def rmse_with_empty_contexts(spark, sf_dir):
    """Tasks of no to two context points: all targets of all tasks count, those without context with the prior mean."""
    run = _flow(spark, sf_dir)
    points = run.generate_tasks(run.dates(*VAL, 5), (0, 3), seed=0)
    return metrics.rmse(run.predicted(predictors.SetConv(0.3, 2.4), points), run.truth(points), ["date", "cell_id"]).withColumn("rmse", F.round("rmse", 4))


RATE, START = 0.1, (0.3, 0.25, 0.1)


def _learned_sql(epochs: int) -> str:
    """Epochs of one step each: the state's logarithms a1..a3, means m1..m3 and v1..v3 of the gradient and its square."""
    steps = [f"t0 AS (SELECT {', '.join(f'ln({x}::DOUBLE) AS a{k}, 0::DOUBLE AS m{k}, 0::DOUBLE AS v{k}' for k, x in enumerate(START, 1))})"]
    for e in range(1, epochs + 1):
        state, p = f"t{e - 1}", "exp(a3)"
        slopes = [f"(s{k} - s / (d + {p}) * d{k}) / (d + {p})" for k in (1, 2)] + [f"-s / (d + {p}) * {p} / (d + {p})"]
        steps.append(f"""g{e} AS (SELECT avg(l) AS l, {', '.join(f'avg(g{k}) AS g{k}' for k in (1, 2, 3))} FROM (SELECT date, avg(power(s / (d + {p}) - y, 2)) AS l, {', '.join(f'avg(2 * (s / (d + {p}) - y) * ({x})) AS g{k}' for k, x in enumerate(slopes, 1))}
FROM {_met_sql(_days_sql(*TRAIN), e, 0, 5, state, "exp(a1)", "exp(a2)")}, {state} GROUP BY 1))""")
        means = ", ".join(f"0.9 * m{k} + 0.1 * g{k} AS m{k}, 0.999 * v{k} + 0.001 * g{k} * g{k} AS v{k}" for k in (1, 2, 3))
        steps.append(f"u{e} AS (SELECT a1, a2, a3, {means} FROM {state}, g{e})")
        steps.append(f"t{e} AS (SELECT {', '.join(f'a{k} - {RATE} * (m{k} / (1 - power(0.9, {e}))) / (sqrt(v{k} / (1 - power(0.999, {e}))) + 1e-8) AS a{k}, m{k}, v{k}' for k in (1, 2, 3))} FROM u{e})")
        steps.append(f"""r{e} AS (SELECT round(sqrt(avg(power((s / (d + exp(a3)) - y) * sd, 2))), 4) AS val_rmse FROM {_met_sql(_days_sql(*VAL), 0, 0, 5, f"t{e}", "exp(a1)", "exp(a2)")}, t{e}, mm)""")
    rows = " UNION ALL ".join(f"SELECT {e} AS epoch, round(l, 6) AS loss, val_rmse, round(exp(a1), 6) AS length1, round(exp(a2), 6) AS length2, round(exp(a3), 6) AS prior FROM g{e}, r{e}, t{e}" for e in range(1, epochs + 1))
    return f"""WITH {FLOW}, {", ".join(steps)}, e AS ({rows}),
w AS (SELECT *, min(val_rmse) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e)
SELECT epoch, loss, val_rmse, length1, length2, prior, val_rmse < coalesce(before, 'inf'::DOUBLE) AS is_best FROM w"""


@query(_learned_sql(2))
def learn_lengths(spark, sf_dir):
    """Two epochs of gradient descent on both kernel lengths and the prior's weight, contexts of no to four cells."""
    found = _flow(spark, sf_dir).fit(None, predictors.Kernel(*START, reach=8.0), 2, RATE, None, TRAIN, VAL, 5, (0, 5))
    rounded = {c: F.round(c, 6) for c in ("loss", "length1", "length2", "prior")} | {"val_rmse": F.round("val_rmse", 4)}
    return found.withColumns(rounded)


READOUT = f"""zc AS (SELECT t.cell_id, sum(w * z) / sum(w) AS z FROM (SELECT t.cell_id, CASE WHEN st.mask THEN 1.0 ELSE -1.0 END AS z, exp(-(power((l.x1 - t.x1) / 0.3, 2) + power((l.x2 - t.x2) / 0.25, 2)) / 2) AS w FROM ce t, ce l JOIN st ON st.cell_id = l.cell_id) t GROUP BY 1),
f AS (SELECT [1.0::DOUBLE, s / (d + 0.1), d / (d + 0.1), z, z * s / (d + 0.1), y] AS f FROM {_met_sql(_days_sql(*TRAIN), 1, 0, 5, "(SELECT 0)", "0.3", "0.25")} m JOIN zc ON m.cell_id = zc.cell_id)"""


@query(f"WITH {FLOW}, {READOUT} SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(sum(f[i + 1] * f[j + 1]), 4) AS value FROM f, range(6) a(i), range(6) b(j) WHERE i <= j GROUP BY 1, 2")
def readout_normal_equations(spark, sf_dir):
    """The sums from which the read-out's weights follow: kernel mean, density, the mask layer and its product with the mean."""
    run = _flow(spark, sf_dir)
    context, targets = run._meetings(run.generate_tasks(run.dates(*TRAIN, 5), (0, 5), seed=1))
    return readout.normal_equations(context, targets, predictors.Kernel(*START), run.layer_frames()).withColumn("value", F.round("value", 4))


@query(f"""WITH {DAILY}, {STATIC}, t AS ({GRID}), p AS (SELECT date, target_id, d.x1, d.x2, y, power(d.x1 - t.x1, 2) + power(d.x2 - t.x2, 2) AS d2 FROM d, t),
r AS (SELECT *, row_number() OVER (PARTITION BY date, target_id ORDER BY d2, x1, x2, y) AS rank FROM p)
SELECT CAST(date AS VARCHAR) AS date, target_id, CAST(rank AS INTEGER) AS rank, x1, x2, y, d2 FROM r WHERE rank <= 12""")
def nearest_context(spark, sf_dir):
    """The 12 events nearest to each cell on each date."""
    wanted = _daily(spark, sf_dir).select("date").distinct().crossJoin(_grid_targets(spark, sf_dir))
    found = neighbours.nearest(_daily(spark, sf_dir), wanted, 12).select("date", "target_id", F.posexplode("near").alias("rank", "p"))
    return found.select(F.col("date").cast("string").alias("date"), "target_id", (F.col("rank") + 1).alias("rank"), "p.x1", "p.x2", "p.y", "p.d2")


@query(f"WITH {SERIES} SELECT dayofyear(time) AS doy, cell_id, {MEAN.format('value')} AS clim FROM s GROUP BY 1, 2")
def climatology_merged(spark, sf_dir):
    """The climatology of all orders, merged year by year: a batch for each, one of them run twice, compacted midway."""
    path, rows = f"{tables.shared_folder(spark)}/climatology-{uuid.uuid4().hex}", series(spark, sf_dir)
    of_year = lambda k: rows.where(F.pmod(F.year("time"), F.lit(3)) == k)
    for k in (0, 1, 1, 2):
        increments.merge_batch(of_year(k), k, path, "value", ("cell_id",), scale=2)
        if k == 1:
            increments.compact(spark, path)
    return increments.climatology(spark, path)
