"""Queries: clustering, encoding, models and anomalies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .. import views
from ..functions.numbers import r
from ..operators import anomaly, clean, cluster, dbscan, encode, features, models, series, spatial
from ..session import in_parallel, materialize, scratch_path
from . import sqltext as S
from .registry import query

_LL = ["latitude", "longitude"]


def _xy(spark, d):
    return views.trips(spark, d).select("event_id", "base_station", "datetime", "latitude", "longitude", "value")


# ---- clustering ----------------------------------------------------------------


@query("kmeans")
def kmeans(spark, d):
    return cluster.kmeans(_xy(spark, d).select("event_id", *_LL), _LL, 8)


@query("kmeans_invariants", S.T + "SELECT 8 AS clusters, count(*) AS labelled, 0 AS off_centre, 0 AS dearer_than_one_start FROM trips")
def kmeans_invariants(spark, d):
    """Every row is labelled, no cluster's mean is far from its centre, and ten starts cost no more than the first alone."""
    z = cluster.standardize(_xy(spark, d), _LL).select(*[f"{c}_z" for c in _LL])
    z = materialize(z, "invariants")
    centers, cost = cluster.fit_centers(z, [8])[8]
    t = z.withColumn("c", cluster.nearest([F.col(c) for c in z.columns], centers))
    at = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centers])[F.col("c")]
    means = t.groupBy("c").agg(F.count("*").alias("n"), F.avg(F.col(z.columns[0])).alias("y"), F.avg(F.col(z.columns[1])).alias("x"))
    one = cluster.fit_centers(z, [8], starts=1)[8][1]
    return means.agg(F.count("*").cast("int").alias("clusters"), F.sum("n").alias("labelled"),
                     F.count_if(F.hypot(F.col("y") - at[0], F.col("x") - at[1]) > 0.05).cast("int").alias("off_centre"),
                     F.lit(int(cost > one * (1 + 1e-9))).alias("dearer_than_one_start"))


@query("kmeans_degrees")
def kmeans_degrees(spark, d):
    return cluster.kmeans(_xy(spark, d).select("event_id", *_LL), _LL, 8, scaled=False)


@query("cluster_features")
def cluster_features(spark, d):
    return cluster.cluster_columns(_xy(spark, d).select("event_id", *_LL))


@query("prepare_features", S.T + """SELECT event_id, round((latitude - a1) / s1, 5) AS latitude_z, round((longitude - a2) / s2, 5) AS longitude_z,
  round((sin(2 * pi() * hour(datetime) / 24) - a3) / s3, 5) AS hour_sin_z, round((cos(2 * pi() * hour(datetime) / 24) - a4) / s4, 5) AS hour_cos_z,
  round((value - a5) / s5, 5) AS value_z FROM trips, (SELECT avg(latitude) a1, stddev_pop(latitude) s1, avg(longitude) a2, stddev_pop(longitude) s2,
  avg(sin(2 * pi() * hour(datetime) / 24)) a3, stddev_pop(sin(2 * pi() * hour(datetime) / 24)) s3,
  avg(cos(2 * pi() * hour(datetime) / 24)) a4, stddev_pop(cos(2 * pi() * hour(datetime) / 24)) s4, avg(value) a5, stddev_pop(value) s5 FROM trips)""")
def prepare_features(spark, d):
    t, cols = cluster.place_features(_xy(spark, d), time="datetime", weight="value")
    return features.rounded(cluster.standardize(t, cols).select("event_id", *[f"{c}_z" for c in cols]), 5)


def _dbscan_sql(points: str, eps: float, least: int, last: str) -> str:
    """Density clusters in SQL over ``pts(event_id, y, x)``: core places, cells of half the radius, their components, borders."""
    return S.with_views("trips", recursive=True) + f""",
pts AS ({points}),
p AS (SELECT y, x, count(*) AS n, floor(y / {eps})::BIGINT AS gy, floor(x / {eps})::BIGINT AS gx FROM pts
  WHERE y IS NOT NULL AND x IS NOT NULL GROUP BY y, x),
nb AS MATERIALIZED (SELECT a.y AS ay, a.x AS ax, b.y AS y, b.x AS x, b.n FROM (SELECT *, unnest([gy - 1, gy, gy + 1]) AS ty FROM p) a
  JOIN p b ON b.gy = a.ty AND b.gx BETWEEN a.gx - 1 AND a.gx + 1
  WHERE sqrt((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x)) <= {eps}),
core AS MATERIALIZED (SELECT ay AS y, ax AS x, floor(ay / {eps / 2})::BIGINT AS cy, floor(ax / {eps / 2})::BIGINT AS cx FROM nb GROUP BY ay, ax HAVING sum(n) >= {least}),
node AS MATERIALIZED (SELECT cy, cx, row_number() OVER (ORDER BY cy, cx) AS id FROM (SELECT DISTINCT cy, cx FROM core)),
held AS MATERIALIZED (SELECT core.y, core.x, id FROM core JOIN node USING (cy, cx)),
edge AS MATERIALIZED (SELECT DISTINCT a.id AS u, b.id AS v FROM nb JOIN held a ON a.y = nb.ay AND a.x = nb.ax JOIN held b ON b.y = nb.y AND b.x = nb.x),
cc(id, root) USING KEY (id) AS (SELECT id, id FROM node UNION
  SELECT e.v, min(cc.root) FROM cc JOIN edge e ON e.u = cc.id JOIN recurring.cc r ON r.id = e.v WHERE cc.root < r.root GROUP BY e.v),
num AS (SELECT id, (dense_rank() OVER (ORDER BY root) - 1)::INT AS k FROM cc),
lab AS (SELECT y, x, k FROM held JOIN num USING (id) UNION ALL
  SELECT nb.ay, nb.ax, min(k) FROM nb JOIN held b ON b.y = nb.y AND b.x = nb.x JOIN num USING (id)
  WHERE (nb.ay, nb.ax) NOT IN (SELECT (y, x) FROM core) GROUP BY 1, 2),
place AS (SELECT p.y, p.x, p.n, core.y IS NOT NULL AS is_core, coalesce(k, -1)::INT AS cluster
  FROM p LEFT JOIN core ON core.y = p.y AND core.x = p.x LEFT JOIN lab ON lab.y = p.y AND lab.x = p.x)
{last}"""


_RAW = "SELECT event_id, latitude AS y, longitude AS x FROM trips"
_STD = """SELECT event_id, (latitude - m1) / s1 AS y, (longitude - m2) / s2 AS x FROM trips,
  (SELECT avg(latitude) AS m1, stddev_pop(latitude) AS s1, avg(longitude) AS m2, stddev_pop(longitude) AS s2 FROM trips)"""


@query("dbscan", _dbscan_sql(_RAW, 0.01, 50, """SELECT event_id, latitude, longitude, cluster FROM trips
LEFT JOIN place ON place.y = latitude AND place.x = longitude"""))
def dbscan_query(spark, d):
    t = _xy(spark, d).select("event_id", *_LL)
    return dbscan.dbscan(t, 0.01, 50)


@query("dbscan_summary", _dbscan_sql(_RAW, 0.02, 20, """SELECT cluster, sum(n)::BIGINT AS rows, count(*) AS places,
  count(*) FILTER (is_core) AS core_places FROM place GROUP BY 1"""))
def dbscan_summary(spark, d):
    places = dbscan.dbscan_places(_xy(spark, d), 0.02, 20)
    return places.groupBy("cluster").agg(F.sum("n").alias("rows"), F.count("*").alias("places"),
                                         F.count_if("is_core").alias("core_places"))


@query("dbscan_scaled", _dbscan_sql(_STD, 0.1, 5, """SELECT cluster, count(*) AS n, round(avg(latitude), 6) AS latitude_mean,
  round(stddev_samp(latitude), 6) AS latitude_std, round(avg(longitude), 6) AS longitude_mean, round(stddev_samp(longitude), 6) AS longitude_std,
  round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM pts), 6) AS share_pct
FROM pts JOIN place USING (y, x) JOIN trips USING (event_id) GROUP BY 1"""))
def dbscan_scaled(spark, d):
    t = dbscan.dbscan_scaled(_xy(spark, d).select("event_id", *_LL))
    return features.rounded(dbscan.dbscan_report(materialize(t, "db-scaled"), _LL), 6)


@query("dbscan_quality")
def dbscan_quality(spark, d):
    """Clusters, noise rows and the three indices of the standardised clustering."""
    t = materialize(cluster.standardize(dbscan.dbscan_scaled(_xy(spark, d).select("event_id", *_LL)), _LL), "db-scaled")
    noise = t.where(F.col("cluster") == dbscan.NOISE).agg(F.count("*")).scalar()
    return cluster.quality_indices(t, [f"{c}_z" for c in _LL]).withColumn("noise_rows", noise)


@query("hierarchical")
def hierarchical(spark, d):
    return cluster.kmeans(_xy(spark, d).select("event_id", *_LL), _LL, 8, algorithm="bisecting")


_LAB = S.with_views("trips") + """,
l AS (SELECT latitude AS y, longitude AS x, (latitude >= 40.75)::INT * 3 + (longitude >= -74.1)::INT + (longitude >= -73.9)::INT AS c FROM trips),
k AS (SELECT c, count(*)::DOUBLE AS n, avg(y) AS my, avg(x) AS mx, avg(y * y + x * x) AS q FROM l GROUP BY 1),
g AS (SELECT avg(y) AS gy, avg(x) AS gx, count(*)::DOUBLE AS n FROM l)"""


@query("cluster_quality", _LAB + """,
w AS (SELECT c, avg(sqrt(pow(y - my, 2) + pow(x - mx, 2))) AS s, sum(pow(y - my, 2) + pow(x - mx, 2)) AS ss FROM l JOIN k USING (c) GROUP BY 1),
b AS (SELECT sum(k.n * (pow(my - gy, 2) + pow(mx - gx, 2))) AS bs FROM k, g),
db AS (SELECT avg(m) AS v FROM (SELECT a.c, max((wa.s + wb.s) / sqrt(pow(a.my - b2.my, 2) + pow(a.mx - b2.mx, 2))) AS m
   FROM k a JOIN k b2 ON a.c <> b2.c JOIN w wa ON wa.c = a.c JOIN w wb ON wb.c = b2.c GROUP BY 1)),
dist AS (SELECT l.y, l.x, l.c, k.c AS oc, k.n, pow(l.y - my, 2) + pow(l.x - mx, 2) + q - my * my - mx * mx AS a FROM l, k),
sil AS (SELECT y, x, c, any_value(rn) AS rn, max(a * n / (n - 1)) FILTER (c = oc) AS own, min(a) FILTER (c <> oc) AS oth
  FROM (SELECT *, row_number() OVER (PARTITION BY y, x, c, oc) AS rn FROM dist) GROUP BY y, x, c, rn)
SELECT (SELECT count(*) FROM k) AS clusters, round((SELECT avg((oth - own) / greatest(oth, own)) FROM sil), 5) AS silhouette,
  round((SELECT bs FROM b) / ((SELECT count(*) FROM k) - 1) / ((SELECT sum(ss) FROM w) / ((SELECT n FROM g) - (SELECT count(*) FROM k))), 4) AS calinski_harabasz,
  round((SELECT v FROM db), 5) AS davies_bouldin""")
def cluster_quality(spark, d):
    out = cluster.quality_indices(spatial.grid_labels(_xy(spark, d)), _LL)
    return out.select("clusters", r(F.col("silhouette"), 5).alias("silhouette"), r(F.col("calinski_harabasz"), 4).alias("calinski_harabasz"),
                      r(F.col("davies_bouldin"), 5).alias("davies_bouldin"))


@query("optimal_k")
def optimal_k(spark, d):
    scan = materialize(cluster.k_scan(_xy(spark, d), _LL, range(2, 21)), "kscan-rows")
    best = {m: cluster.pick_k(scan, m) for m in ("silhouette", "calinski", "davies", "elbow")}
    return scan.withColumns({f"best_{m}": (F.col("k") == k).cast("int") for m, k in best.items()})


@query("pivot_cluster_base")
def pivot_cluster_base(spark, d):
    t = cluster.kmeans(_xy(spark, d), _LL, 8)
    # one row per cluster and base, so that any number of bases fits
    return t.groupBy("cluster", "base_station").agg(F.count("*").alias("n"))


@query("cluster_centers_mean")
def cluster_centers_mean(spark, d):
    t = dbscan.dbscan(_xy(spark, d), 0.02, 20)
    return t.where("cluster >= 0").groupBy("cluster").agg(
        F.count("*").alias("n"), r(F.avg("latitude")).alias("lat"), r(F.avg("longitude")).alias("lon"))


# ---- encoding, scaling, selection ----------------------------------------------------

_BASES = ("click", "error", "purchase", "signup", "view")


@query("encode_categorical", S.with_views("dirty") + """,
c AS (SELECT v, dense_rank() OVER (ORDER BY v) - 1 AS k FROM (SELECT DISTINCT coalesce(base_station, 'Unknown') AS v FROM dirty)),
p AS (SELECT v, dense_rank() OVER (ORDER BY v) - 1 AS k FROM (SELECT DISTINCT pickup_area AS v FROM dirty))
SELECT event_id, base_station, pickup_area, c.k::INT AS base_station_encoded, p.k::INT AS pickup_area_encoded, """ + ", ".join(
    f"coalesce(base_station = '{b}', false)::INT AS base_station_{b}" for b in _BASES) + """, (base_station IS NULL)::INT AS base_station_nan
FROM dirty JOIN c ON c.v = coalesce(base_station, 'Unknown') JOIN p ON p.v = pickup_area""")
def encode_categorical(spark, d):
    return encode.encode_categorical(views.dirty_trips(spark, d).select("event_id", "base_station", "pickup_area"))


_SC = ["c_acctbal", "c_custkey"]


def _scale_sql(shift, width):
    return "SELECT c_custkey, " + ", ".join(
        f"round(({c} - {shift.format(c=c)}) / {width.format(c=c)}, 5) AS {c}_scaled" for c in _SC) + " FROM customer"


for _m, _a, _b in (
    ("standard", "(SELECT avg({c}) FROM customer)", "(SELECT stddev_pop({c}) FROM customer)"),
    ("robust", "(SELECT quantile_cont({c}, 0.5) FROM customer)", "(SELECT quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) FROM customer)"),
    ("minmax", "(SELECT min({c}) FROM customer)", "(SELECT (max({c}) - min({c}))::DOUBLE FROM customer)"),
):
    query(f"scale_{_m}", _scale_sql(_a, _b))(
        lambda spark, d, m=_m: encode.scale(views.table(spark, d, "customer"), _SC, m).select(
            "c_custkey", *[r(F.col(f"{c}_scaled"), 5).alias(f"{c}_scaled") for c in _SC]))


@query("prep_categorical_codes", S.with_views("dirty") + """,
c AS (SELECT v, dense_rank() OVER (ORDER BY v) - 1 AS k FROM (SELECT DISTINCT base_station AS v FROM dirty WHERE base_station IS NOT NULL))
SELECT event_id, coalesce(c.k, -1)::INT AS base_station FROM dirty LEFT JOIN c ON v = base_station""")
def prep_categorical_codes(spark, d):
    return encode.category_codes(views.dirty_trips(spark, d).select("event_id", "base_station"), ["base_station"])


@query("prep_fill", S.D + """SELECT event_id, round(coalesce(latitude, (SELECT quantile_cont(latitude, 0.5) FROM dirty)), 6) AS latitude,
  coalesce(base_station, (SELECT base_station FROM dirty WHERE base_station IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS base_station FROM dirty""")
def prep_fill(spark, d):
    return features.rounded(encode.fill_for_model(views.dirty_trips(spark, d).select("event_id", "latitude", "base_station")))


@query("train_test_split", S.with_views("trips") + """,
h AS (SELECT base_station, date_trunc('hour', datetime) AS hour_date, count(*) AS demand FROM trips GROUP BY 1, 2)
SELECT base_station, hour_date, demand, ('0x' || substr(md5('42:' || base_station || '|' || strftime(hour_date, '%Y-%m-%d %H:%M:%S')), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.2 AS is_test FROM h""")
def train_test_split(spark, d):
    t = models.demand_table(views.trips(spark, d), ["base_station"])
    key = models.row_key(["base_station", "hour_date"])
    return encode.mark_test(t.select("base_station", "hour_date", "demand"), key)


_CAND = ["l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


_CORR = ["vehicle_id", "longitude", "wait_time", "value", "event_id"]


@query("select_features_corr", S.T + "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(abs(corr({c}, latitude)), 6) AS score FROM trips" for c in _CORR) + ") WHERE score > 0.01")
def select_features_corr(spark, d):
    return features.rounded(encode.select_by_correlation(views.trips(spark, d), "latitude", _CORR))


@query("select_features_variance", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(var_pop(coalesce({c}, 0)), 4) AS score FROM lineitem" for c in _CAND) + ") WHERE score > 0.01")
def select_features_variance(spark, d):
    return features.rounded(encode.select_by_variance(views.table(spark, d, "lineitem"), _CAND), 4)


# ---- models -----------------------------------------------------------------------------


@query("hourly_demand_dataset", S.T + """SELECT date_trunc('hour', datetime) AS hour_date, count(*) AS demand, hour(min(datetime))::INT AS hour,
  (isodow(min(datetime)) - 1)::INT AS day_of_week, month(min(datetime))::INT AS month, min(datetime)::DATE AS date,
  round(avg(latitude) + 3e-9, 6) AS lat_mean, round(avg(longitude) + 3e-9, 6) AS lon_mean FROM trips GROUP BY 1""")
def hourly_demand_dataset(spark, d):
    t = models.demand_table(views.trips(spark, d))
    return t.withColumns({c: F.round(F.col(c) + 3e-9, 6) for c in ("lat_mean", "lon_mean")})


_CAT = ["base_station"]
_LEARNERS = {"linear": {}, "random_forest": {}, "gbt_xgb": {}, "gbt_lgb": {}}  # each with its own defaults


def _table(spark, d):
    return models.prepare(models.demand_table(views.trips(spark, d), _CAT), ["base_station", "hour_date"])


for _n, _model, _kw in (("linear_regression", "linear", {}), ("random_forest", "random_forest", {}),
                        ("gbt_xgb", "gbt_xgb", {}), ("gbt_lgb", "gbt_lgb", {})):
    query(_n)(lambda spark, d, m=_model, kw=_kw: models.train_and_measure(_table(spark, d), m, _CAT, **kw))


@query("feature_importance")
def feature_importance(spark, d):
    m = models.fit(_table(spark, d), "random_forest", _CAT)
    return models.importances(m, models.NUMERIC, _CAT, spark).orderBy(F.desc("importance"))


@query("select_features_importance")
def select_features_importance(spark, d):
    return feature_importance(spark, d).where("importance > 0.01")


@query("score_demand")
def score_demand(spark, d):
    t = _table(spark, d)
    return models.score(models.fit(t, "linear", _CAT), t.where("is_test").drop("demand"), ["base_station", "hour_date"])


@query("model_comparison")
def model_comparison(spark, d):
    return models.compare(_table(spark, d), _LEARNERS, _CAT)


@query("voting_ensemble")
def voting_ensemble(spark, d):
    e = models.ensemble(_table(spark, d), _LEARNERS, _CAT)
    return models.split_metrics(e, "vote")


_VOTE = (1.0, 2.0, 1.0)


@query("voting_given_predictions", S.with_views("base_hourly") + """ SELECT base_station, hour, round((a * 1 + b * 2 + c * 1) / 4, 6) AS prediction FROM (
  SELECT base_station, hour, lag(demand, 1) OVER w AS a, lag(demand, 24) OVER w AS b, lag(demand, 168) OVER w AS c FROM base_hourly
  WINDOW w AS (PARTITION BY base_station ORDER BY hour))""")
def voting_given_predictions(spark, d):
    h = series.add_lags(series.hourly_counts(views.trips(spark, d), _CAT), "demand", (1, 24, 168), _CAT, prefix="lag")
    v = models.weighted_vote(h, ["lag_1", "lag_24", "lag_168"], _VOTE)
    return features.rounded(v.select("base_station", "hour", "prediction"))


@query("grid_search")
def grid_search(spark, d):
    return models.grid_search(_table(spark, d), "random_forest", {"numTrees": [5, 10], "maxDepth": [3, 5]}, folds=5, categorical=_CAT)


@query("cross_validation")
def cross_validation(spark, d):
    return models.cross_validate(_table(spark, d), "linear", 5, _CAT)


def _saved(spark, d):
    """All learners, fitted and written; the table they were fitted on and their folder."""
    t = _table(spark, d)
    path = scratch_path(spark, "models")
    models.save_models(dict(zip(_LEARNERS, in_parallel(lambda n: models.fit(t, n, _CAT), _LEARNERS))), path)
    return t, path


@query("save_models")
def save_models(spark, d):
    t, path = _saved(spark, d)
    loaded = models.load_models(path, list(_LEARNERS))
    return reduce(DataFrame.unionByName, [models.split_metrics(models.score(m, t, ["row_key", "is_test", "demand"]), n) for n, m in loaded.items()])


@query("load_models", S.with_views("trips") + """,
h AS (SELECT base_station, date_trunc('hour', datetime) AS hour_date FROM trips GROUP BY 1, 2)
SELECT base_station, hour_date, 0 AS differs FROM h""")
def load_models(spark, d):
    """Predictions of a model before it was written and after it was read; differs is 1 where they are not equal."""
    t = _table(spark, d)
    path, keep = scratch_path(spark, "model"), ["base_station", "hour_date"]
    m = models.fit(t, "random_forest", _CAT, numTrees=20)
    models.save_models({"forest": m}, path)
    both = models.ensemble_of([m, models.load_models(path, ["forest"])["forest"]], t, keep)
    return both.select(*keep, (F.col("p0") != F.col("p1")).cast("int").alias("differs"))


# ---- anomalies ------------------------------------------------------------------------------

_ANOM = ["latitude", "longitude", "wait_time", "value"]


@query("anomaly_iforest")
def anomaly_iforest(spark, d):
    t = views.dirty_trips(spark, d).select("event_id", *_ANOM)
    return anomaly.isolation_flags(t, _ANOM, "event_id", 0.05).select("event_id", r(F.col("score")).alias("score"), "is_anomaly")


@query("outliers_iforest")
def outliers_iforest(spark, d):
    t = views.dirty_trips(spark, d).select("event_id", *_ANOM)
    return clean.remove_outliers_forest(t, _ANOM, "event_id")


@query("anomaly_reconstruction")
def anomaly_reconstruction(spark, d):
    return anomaly.reconstruction_errors(views.table(spark, d, "embeddings"), "embedding", 8).select("vec_id", "error", "is_anomaly")
