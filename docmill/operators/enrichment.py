"""Weather, location and map payloads as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weather codes of the World Meteorological Organization.
WEATHER_CODES = {
    0: "clear sky", 1: "mainly clear", 2: "partly cloudy", 3: "overcast", 45: "foggy",
    48: "depositing rime fog", 51: "light drizzle", 53: "moderate drizzle", 55: "dense drizzle",
    61: "slight rain", 63: "moderate rain", 65: "heavy rain", 71: "slight snow",
    73: "moderate snow", 75: "heavy snow", 80: "slight rain showers",
    81: "moderate rain showers", 82: "violent rain showers", 95: "thunderstorm",
    96: "thunderstorm with slight hail", 99: "thunderstorm with heavy hail",
}
FORECAST_HOURS = 24
WEATHER_SCHEMA = (
    "current struct<temperature_2m:double,relative_humidity_2m:int,weather_code:int,"
    "wind_speed_10m:double>, hourly struct<temperature_2m:array<double>>"
)
FEATURE_SCHEMA = (
    "geometry struct<type:string,coordinates:string>, properties struct<LABEL_FR:string,"
    "LABEL_NL:string,STATUS_FR:string,STATUS_NL:string,ROAD_IMPL_FR:string,ROAD_IMPL_NL:string,"
    "PGM_START_DATE:string,PGM_END_DATE:string>"
)


def weather_description(code: Column) -> Column:
    pairs = [F.lit(x) for pair in WEATHER_CODES.items() for x in pair]
    return F.coalesce(
        F.create_map(*pairs)[code], F.concat(F.lit("weather code "), code.cast("string"))
    )


def weather_readings(
    payloads: DataFrame, payload_col: str = "payload", unit: str = "celsius"
) -> DataFrame:
    """Readings from JSON payloads (``location_name``, payload): current values, description,
    high and low of the first 24 hours, and the sentence people see."""
    sign = "°C" if unit == "celsius" else "°F"
    rows = payloads.withColumn("_p", F.from_json(payload_col, WEATHER_SCHEMA))
    now = F.col("_p.current")
    hours = F.slice(F.col("_p.hourly.temperature_2m"), 1, FORECAST_HOURS)
    rows = rows.withColumns(
        {
            "temperature": now["temperature_2m"],
            "unit": F.lit(sign),
            "description": weather_description(now["weather_code"]),
            "humidity": now["relative_humidity_2m"],
            "wind_kmh": now["wind_speed_10m"],
            "high_24h": F.array_max(hours),
            "low_24h": F.array_min(hours),
        }
    ).drop("_p", payload_col)
    # The words of the summary sentence.
    sentence = F.concat(
        F.col("location_name"), F.lit(": "), F.col("temperature").cast("string"), F.lit(sign + ", "),
        F.col("description"), F.lit(", humidity "), F.col("humidity").cast("string"),
        F.lit("%, wind "), F.col("wind_kmh").cast("string"), F.lit(" km/h"),
    )
    forecast = F.concat(
        F.lit("\n24h forecast: High "), F.col("high_24h").cast("string"), F.lit(sign + ", Low "),
        F.col("low_24h").cast("string"), F.lit(sign),
    )
    return rows.withColumn(
        "summary", F.concat(sentence, F.coalesce(forecast, F.lit("")))
    )


def weather_by_location(readings: DataFrame) -> DataFrame:
    return readings.groupBy("location_name").agg(
        F.count(F.lit(1)).alias("readings"),
        F.max("high_24h").alias("high"),
        F.min("low_24h").alias("low"),
        F.avg("temperature").alias("avg_temperature"),
    )


def parse_location(col: Column) -> tuple[Column, Column, Column]:
    """Latitude, longitude and name of ``lat,lon`` text; NULLs for a place name. Text of two
    parts made of digits, dots and minus signs counts as coordinates."""
    parts = F.split(col, ",")
    numeric = (F.size(parts) == 2) & F.forall(
        parts, lambda p: F.translate(p, ".-", "").rlike("^[0-9]+$")
    )
    lat = F.when(numeric, F.get(parts, F.lit(0)).try_cast("double"))
    lon = F.when(numeric, F.get(parts, F.lit(1)).try_cast("double"))
    name = F.when(
        lat.isNotNull() & lon.isNotNull(), F.format_string("%.2f°, %.2f°", lat, lon)
    )
    return lat, lon, name


def feature_flatten(features: DataFrame, json_col: str = "feature") -> DataFrame:
    """GeoJSON features as flat rows with the label in the asked language (``fr`` unless
    ``nl``). Features without geometry are left out."""
    rows = features.withColumn("_f", F.from_json(json_col, FEATURE_SCHEMA)).where(
        F.col("_f.geometry.coordinates").isNotNull()
    )
    props = F.col("_f.properties")
    dutch = F.col("language") == "nl"
    return rows.select(
        *[c for c in features.columns if c not in (json_col, "language")],
        F.when(dutch, "nl").otherwise("fr").alias("language"),
        F.col("_f.geometry.type").alias("geometry_type"),
        F.col("_f.geometry.coordinates").alias("coordinates"),
        F.when(dutch, props["LABEL_NL"]).otherwise(props["LABEL_FR"]).alias("label"),
        *[
            props[name].alias(name.lower())
            for name in (
                "LABEL_FR", "LABEL_NL", "STATUS_FR", "STATUS_NL", "ROAD_IMPL_FR", "ROAD_IMPL_NL",
                "PGM_START_DATE", "PGM_END_DATE",
            )
        ],
    )


def polygon_points(geometry_type: Column, coordinates: Column) -> Column:
    """All points of a polygon or multi-polygon as ``(lat, lon)``; rings whose points are not
    pairs are left out."""
    single = F.from_json(coordinates, "array<array<array<double>>>")
    multi = F.from_json(coordinates, "array<array<array<array<double>>>>")
    rings = F.when(geometry_type == "MultiPolygon", F.flatten(multi)).otherwise(single)
    flat = F.flatten(F.filter(rings, lambda r: F.size(F.get(r, F.lit(0))) == 2))
    return F.transform(
        flat,
        lambda p: F.struct(F.get(p, F.lit(1)).alias("lat"), F.get(p, F.lit(0)).alias("lon")),
    )


def polygon_bounds(features: DataFrame) -> DataFrame:
    """Bounds and number of points of flattened features."""
    rows = features.withColumn(
        "_points", polygon_points(F.col("geometry_type"), F.col("coordinates"))
    )
    lat = F.transform("_points", lambda p: p["lat"])
    lon = F.transform("_points", lambda p: p["lon"])
    return rows.withColumns(
        {
            "points": F.size("_points"),
            "south": F.array_min(lat),
            "west": F.array_min(lon),
            "north": F.array_max(lat),
            "east": F.array_max(lon),
        }
    ).drop("_points")
