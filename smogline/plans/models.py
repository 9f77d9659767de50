"""Queries of splits, models and explanations."""

from __future__ import annotations

from pyspark.sql import functions as F

from smogline import constants as K
from smogline.functions import aqi, risk
from smogline.operators import explain, features, matching, models, profile, series, splits
from smogline.plans import sqltext as S
from smogline.plans.profiles import _horizons
from smogline.plans.registry import query
from smogline.session import materialise


@query("temporal_split", "", """
    SELECT record_id, CASE WHEN row_number() OVER (ORDER BY timestamp_utc, record_id) <= floor((SELECT count(*) FROM v_features) * 0.8::DOUBLE)
           THEN 'train' ELSE 'test' END AS split FROM v_features""")
def _temporal(t):
    return splits.temporal_split(t.v_features, tie=["record_id"]).select("record_id", "split")


@query("temporal_split_date", "", """
    SELECT record_id, CASE WHEN timestamp_utc < TIMESTAMP '2000-01-01' THEN 'train' ELSE 'test' END AS split FROM v_features""")
def _temporal_date(t):
    return splits.split_by_date(t.v_features, "2000-01-01").select("record_id", "split")


@query("group_kfold", "", """
    WITH g AS (SELECT coalesce(CAST(s AS VARCHAR), 'station_unassigned') AS g, count(*) AS n FROM
                 (SELECT CASE WHEN station_id % 7 = 0 THEN NULL ELSE station_id END AS s FROM v_features) GROUP BY 1),
         r AS (SELECT g, row_number() OVER (ORDER BY n DESC, g) - 1 AS k FROM g)
    SELECT record_id, CAST(CASE WHEN (k // 5) % 2 = 0 THEN k % 5 ELSE 4 - k % 5 END AS INT) AS fold
    FROM v_features JOIN r ON g = coalesce(CAST(CASE WHEN station_id % 7 = 0 THEN NULL ELSE station_id END AS VARCHAR), 'station_unassigned')""")
def _kfold(t):
    gaps = t.v_features.withColumn("station_id", F.when(F.col("station_id") % 7 != 0, F.col("station_id")))
    return splits.group_kfold(gaps).select("record_id", "fold")


@query("latitude_kfold", "", """
    WITH e AS (SELECT quantile_cont(latitude, 0.2) AS a, quantile_cont(latitude, 0.4) AS b, quantile_cont(latitude, 0.6) AS c, quantile_cont(latitude, 0.8) AS d FROM v_features)
    SELECT record_id, CASE WHEN latitude > a THEN 1 ELSE 0 END + CASE WHEN latitude > b THEN 1 ELSE 0 END + CASE WHEN latitude > c THEN 1 ELSE 0 END
           + CASE WHEN latitude > d THEN 1 ELSE 0 END AS fold FROM v_features, e""")
def _latitude(t):
    return splits.latitude_kfold(t.v_features).select("record_id", "fold")


@query("leave_city_out", "", "SELECT record_id, CASE WHEN city_key IN (0, 1, 2) THEN 'train' ELSE 'test' END AS split FROM v_features")
def _city(t):
    return splits.leave_city_out(t.v_features, [0, 1, 2], "city_key").select("record_id", "split")


def _halves(t):
    marked = splits.temporal_split(t.v_features.filter(F.col("pm25_ground").isNotNull())
                                   .withColumns({f"is_{g}_missing": F.col(f"satellite_{g}").isNull().cast("int") for g in ("no2", "so2", "co", "o3")})
                                   .withColumn("is_aod_missing", F.col("aod_550nm").isNull().cast("int")), tie=["record_id"])
    stored = materialise(marked, "split")
    return stored.filter("split = 'train'"), stored.filter("split = 'test'")


@query("train_baselines", "mae rmse r2 cv_mae cv_rmse cv_r2")
def _baselines(t):
    train, test = _halves(t)
    return models.train_baselines(train, test)


def _forecast_rows(t):
    known = t.v_features.filter(F.col("pm25_ground").isNotNull()).withColumns(
        {f"is_{g}_missing": F.col(f"satellite_{g}").isNull().cast("int") for g in ("no2", "so2", "co", "o3")} | {"is_aod_missing": F.col("aod_550nm").isNull().cast("int")})
    return models.forecast_rows(known, tie=["record_id"])


@query("train_horizons", "persistence_mae mae rmse r2 gain_pct")
def _train_horizons(t):
    train, test = _forecast_rows(t)
    names = [c for c in train.columns if "_lag_" in c or "_rolling_" in c]
    return models.train_horizons(train, test, names)


_LEADS = ", ".join(f"lead(pm25_ground, {h}) OVER w AS l{h}" for h in K.HORIZON_HOURS)


@query("forecast_rows", "mae rmse", f"""
    WITH l AS (SELECT record_id, timestamp_utc, pm25_ground, {_LEADS} FROM v_features WHERE pm25_ground IS NOT NULL WINDOW w AS (PARTITION BY station_id ORDER BY timestamp_utc, record_id)),
         k AS (SELECT *, row_number() OVER (ORDER BY timestamp_utc, record_id) AS rn, count(*) OVER () AS total FROM l WHERE l1 IS NOT NULL),
         t AS (SELECT * FROM k WHERE rn > floor(total * 0.8::DOUBLE))
    {' UNION ALL '.join(f"SELECT CAST({h} AS INT) AS horizon_hours, count(l{h}) AS n, avg(abs(l{h} - pm25_ground)) AS mae, sqrt(avg((l{h} - pm25_ground) * (l{h} - pm25_ground))) AS rmse FROM t" for h in K.HORIZON_HOURS)}""")
def _test_rows(t):
    # the test rows of train_horizons and their persistence error
    found = profile.persistence_baseline(_forecast_rows(t)[1]).drop("gain_pct")
    # without a pair there is no error
    return found.withColumns({c: F.when(F.col("n") > 0, F.col(c)) for c in ("mae", "rmse")})


@query("ablation", "mae rmse r2 mae_gain_pct")
def _ablation(t):
    return models.ablation(*_halves(t))


@query("batch_score", "prediction")
def _score(t):
    from pyspark.ml.regression import LinearRegression
    train, test = _halves(t)
    fs = features.FeatureSet("full", keep=["record_id", K.TARGET]).fit(train)
    model = models.fit(fs.transform(train), fs.names, K.TARGET, LinearRegression(labelCol="label", solver="normal", regParam=1e-6))
    return models.batch_score(model, fs, test).select("record_id", "prediction")


COEFFICIENTS = {"aod_550nm": 60.0, "temperature_2m": -0.7, "wind_speed_10m": -1.5, "road_density": 0.9, "boundary_layer_height": -0.01}
_NAMES = list(COEFFICIENTS)
_CONTRIB = " UNION ALL ".join(
    f"SELECT record_id, (SELECT {' + '.join(f'{v}::DOUBLE * avg({n})' for n, v in COEFFICIENTS.items())} FROM v_features) + 12 AS base_value, '{c}' AS feature, "
    f"{i} AS pos, {c} AS value, coalesce(({c} - (SELECT avg({c}) FROM v_features)) * {k}::DOUBLE, 0) AS contribution FROM v_features"
    for i, (c, k) in enumerate(COEFFICIENTS.items()))


@query("linear_contributions", "base_value value contribution", f"SELECT record_id, base_value, feature, value, contribution FROM ({_CONTRIB})")
def _contributions(t):
    return explain.linear_contributions(t.v_features, ["record_id"], COEFFICIENTS, 12.0)


@query("topk_contributions", "value contribution", f"""
    SELECT record_id, CAST(rank AS INT) AS rank, feature, value, contribution FROM (
      SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY abs(contribution) DESC, pos) AS rank FROM ({_CONTRIB})) WHERE rank <= 4""")
def _topk(t):
    return explain.topk_contributions(t.v_features, ["record_id"], COEFFICIENTS, 4)


@query("global_importance", "importance", f"""
    SELECT feature, importance, CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INT) AS rank
    FROM (SELECT feature, avg(abs(contribution)) AS importance FROM ({_CONTRIB}) GROUP BY 1)""")
def _importance(t):
    return explain.global_importance(t.v_features, COEFFICIENTS)


def _fixed(x: str) -> str:
    """One decimal, half away from zero."""
    return f"CAST(CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(30, 16)), 1) AS DECIMAL(20, 1)) AS VARCHAR)"


_KNOWN_CONTRIB = _CONTRIB.replace("v_features", "(SELECT * FROM v_features WHERE pm25_ground IS NOT NULL)")
_DRIVER = "CASE feature " + " ".join(f"WHEN '{c}' THEN '{K.DRIVER_NAMES[c].capitalize()}'" for c in _NAMES) + " END"


@query("narrative", "", f"""
    WITH c AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY abs(contribution) DESC, pos) AS rank FROM ({_KNOWN_CONTRIB})),
         l AS (SELECT record_id, any_value(base_value) AS base, string_agg('- ' || {_DRIVER} || ': ' || CASE WHEN contribution > 0 THEN '+' ELSE '-' END
                      || {_fixed('abs(contribution)')} || ' ug/m3', chr(10) ORDER BY rank) AS lines FROM c WHERE rank <= 4 GROUP BY record_id)
    SELECT record_id, 'Estimated PM2.5: ' || {_fixed('pm25_ground')} || ' ug/m3, class ' ||
           CASE WHEN pm25_ground <= 30 THEN 'GOOD' WHEN pm25_ground <= 60 THEN 'SATISFACTORY' WHEN pm25_ground <= 90 THEN 'MODERATE'
                WHEN pm25_ground <= 120 THEN 'POOR' WHEN pm25_ground <= 250 THEN 'VERY POOR' ELSE 'SEVERE' END || '.' || chr(10) ||
           'That lies ' || {_fixed('abs(pm25_ground - base)')} || ' ug/m3 ' || CASE WHEN pm25_ground > base THEN 'above' ELSE 'below' END || ' the usual ' || {_fixed('base')} || ' ug/m3.'
           || chr(10) || 'Largest contributions:' || chr(10) || lines AS narrative
    FROM l JOIN v_features USING (record_id)""")
def _narrative(t):
    made = explain.contributions_array(t.v_features.filter(F.col("pm25_ground").isNotNull()), COEFFICIENTS, 12.0)
    return made.select("record_id", risk.narrative(F.col("pm25_ground"), F.col("base_value"),
                                                   explain.topk(F.col("contributions"), 4)).alias("narrative"))


@query("forecast_table", "predicted_pm25 predicted_aqi", f"""
    SELECT record_id, horizon_hours, {S.bround('v')} AS predicted_pm25, predicted_aqi, {S.category('predicted_aqi')} AS category,
           {S.color('predicted_aqi')} AS color, target_time FROM (
      SELECT *, {S.bround('s')} AS predicted_aqi FROM (
        SELECT *, {S.subindex('v', 'pm25')} AS s FROM (
          SELECT record_id, h AS horizon_hours, greatest(pm25_ground * (1 - h / 100.0::DOUBLE), 0) AS v, timestamp_utc + to_hours(h) AS target_time
          FROM v_features, (VALUES (1), (6), (12), (24)) AS hh(h) WHERE pm25_ground IS NOT NULL)))""")
def _forecast(t):
    known = t.v_features.filter(F.col("pm25_ground").isNotNull())
    return explain.forecast_table(known, ["record_id"], {h: F.col("pm25_ground") * (1 - h / 100.0) for h in K.HORIZON_HOURS})


_NEAR_KM = S.flat("b.latitude", "b.longitude", "s.latitude", "s.longitude")
_FLAT_FIELDS = {
    "predicted_pm25": "predicted_pm25", "predicted_aqi": "predicted_aqi", "category": "category", "color": "color", "health_advisory": "health_advisory",
    "margin_of_error": "uncertainty.margin_of_error", "lower_bound": "uncertainty.pm25_lower_bound", "upper_bound": "uncertainty.pm25_upper_bound",
    "uncertainty_level": "uncertainty.uncertainty_level", "reliability_score": "data_reliability.reliability_score", "reliability_level": "data_reliability.reliability_level",
    "modis_aod": "data_reliability.inputs_verified.modis_aod", "station": "station_comparison.nearest_station_name", "station_km": "station_comparison.distance_to_station_km",
    "delta_pm25": "station_comparison.delta_pm25", "delta_direction": "station_comparison.delta_direction", "prediction_id": "provenance.prediction_id"}


@query("response_fields", "predicted_pm25 predicted_aqi margin_of_error lower_bound upper_bound station_km delta_pm25", f"""
    WITH b AS (SELECT * EXCLUDE (station_id) FROM v_features WHERE pm25_ground IS NOT NULL),
         m AS (SELECT station_id, avg(pm25_ground) AS station_pm25 FROM v_pm25 GROUP BY 1), s AS (SELECT station_id, name, latitude, longitude, station_pm25 FROM v_stations JOIN m USING (station_id)),
         n AS (SELECT b.*, s.name AS station, s.station_pm25, round({_NEAR_KM}, 6) AS km6 FROM b, s QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY round({_NEAR_KM}, 6), s.station_id) = 1),
         k AS (SELECT *, {S.bround('km6', 2)} AS km, {S.subindex('pm25_ground', 'pm25')} AS sub, pm25_ground - station_pm25 AS raw FROM n),
         i AS (SELECT *, {S.bround('sub')} AS predicted_aqi, {S.bround('raw')} AS delta_pm25,
                      1.645::DOUBLE * (12.5::DOUBLE * (1.0 + 0.03::DOUBLE * least(km, 30.0)) * CASE WHEN aod_550nm IS NULL THEN 1.45::DOUBLE ELSE 1.0 END
                      * CASE WHEN boundary_layer_height < 400 THEN 1.25::DOUBLE ELSE 1.0 END) AS spread,
                      round_even(100.0::DOUBLE - least(km * 1.5, 30.0) - CASE WHEN aod_550nm IS NULL THEN 22 ELSE 0 END - CASE WHEN satellite_no2 IS NULL THEN 10 ELSE 0 END - 3.0, 0) AS score FROM k),
         e AS (SELECT *, {S.bround('spread')} AS margin_of_error FROM i),
         f AS (SELECT *, pm25_ground - margin_of_error AS lo, pm25_ground + margin_of_error AS hi, margin_of_error / greatest(pm25_ground, 20.0) * 100.0 AS p FROM e),
         g AS (SELECT *, {S.bround('p')} AS pct FROM f)
    SELECT record_id, {S.bround('pm25_ground')} AS predicted_pm25, predicted_aqi, {S.category('predicted_aqi')} AS category, {S.color('predicted_aqi')} AS color, {S.advisory('predicted_aqi')} AS health_advisory,
           margin_of_error, greatest(0.0, {S.bround('lo')}) AS lower_bound, {S.bround('hi')} AS upper_bound, CASE WHEN pct < 20 THEN 'LOW' WHEN pct < 40 THEN 'MEDIUM' ELSE 'HIGH' END AS uncertainty_level,
           CAST(greatest(least(score, 99), 25) AS INT) AS reliability_score, CASE WHEN score >= 80 THEN 'HIGH' WHEN score >= 55 THEN 'MEDIUM' ELSE 'LOW' END AS reliability_level,
           aod_550nm IS NOT NULL AS modis_aod, station, km AS station_km, delta_pm25, CASE WHEN delta_pm25 > 0 THEN 'HIGHER' WHEN delta_pm25 < 0 THEN 'LOWER' ELSE 'EQUAL' END AS delta_direction,
           'PRED-' || upper(substr(sha256(concat_ws(':', CAST(latitude AS VARCHAR), CAST(longitude AS VARCHAR), CAST(timestamp_utc AS VARCHAR), 'v1')), 1, 12)) AS prediction_id FROM g""")
def _response_fields(t):
    """The nested record of response_struct, field by field."""
    return _response(t).select("record_id", *[F.col(f"response.{path}").alias(name) for name, path in _FLAT_FIELDS.items()])


@query("response_struct", "")
def _response(t):
    """Current conditions of every order's position as one nested record."""
    points = t.v_features.filter(F.col("pm25_ground").isNotNull())
    means = t.v_pm25.groupBy("station_id").agg(F.avg("pm25_ground").alias("station_pm25"))
    stations = t.v_stations.join(means, "station_id").select("station_id", "name", "latitude", "longitude", "station_pm25")
    near = matching.nearest_reference_point(points.drop("station_id"), stations, ["name", "station_pm25"], ["station_id"],
                                            ref_lat="latitude", ref_lon="longitude")
    advice = profile.best_horizon_window(_horizons(t), ["record_id"])
    pm25, km = F.col("pm25_ground"), F.col("distance_km")
    index = aqi.pm25_index(pm25)
    missing = F.col("aod_550nm").isNull()
    return near.join(advice, "record_id", "left").select("record_id", F.struct(
        "latitude", "longitude", F.bround(pm25, 1).alias("predicted_pm25"), index.alias("predicted_aqi"),
        aqi.category(index).alias("category"), aqi.color_of_index(index).alias("color"),
        F.lit("PM2.5").alias("dominant_pollutant"), aqi.advisory(index).alias("health_advisory"), F.col("timestamp_utc").alias("timestamp"),
        risk.prediction_interval(pm25, km, missing, F.col("boundary_layer_height")).alias("uncertainty"),
        risk.reliability(km, missing, F.col("satellite_no2").isNull(), F.lit(0.15)).alias("data_reliability"),
        risk.station_delta(pm25, F.col("station_pm25"), F.col("name"), km).alias("station_comparison"),
        F.struct("recommended_window", "lowest_predicted_pm25", "peak_hazard_pm25", "peak_hazard_horizon", "advice").alias("outdoor_advisor"),
        F.struct(risk.prediction_id(F.col("latitude"), F.col("longitude"), F.col("timestamp_utc"), F.lit("v1")).alias("prediction_id"),
                 F.lit("v1").alias("model_version")).alias("provenance")).alias("response"))
