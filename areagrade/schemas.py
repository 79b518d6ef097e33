"""Input schemas, report column names and the fixed values of the domain."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

# --- fixed values -----------------------------------------------------------

WINDOW_START = datetime(2012, 1, 1, 0, 0)
WINDOW_END = datetime(2013, 12, 31, 23, 59)
WINDOW_DAYS = 731  # 2012 was a leap year

INCIDENT_TIME_FORMATS = ("MM/dd/yyyy H:mm", "yyyy-MM-dd H:mm")
REQUEST_TIME_FORMATS = (
    "MM/dd/yyyy hh:mm:ss a",
    "MM/dd/yyyy H:mm:ss",
    "MM/dd/yyyy H:mm",
    "MM/dd/yyyy",
    "yyyy-MM-dd'T'HH:mm:ss[.SSS]",
    "yyyy-MM-dd H:mm:ss",
)

REQUEST_INCLUDE = "Street"
REQUEST_EXCLUDE = "Noise"
IGNORED_CATEGORIES = ("UNKNOWN", "Unspecified")
DUPLICATE_AREA_MARK = "NY"
STREET_ALIASES = {"AVE OF THE AMER": "AVE OF THE AMERICAS"}

# distinct categories at least -> categories kept
TIERS_FIVE = ((5, 5), (3, 3), (1, 1))
TIERS_THREE = ((3, 3), (1, 1))
TIER_ONE = ((1, 1),)

RATE_COLUMNS = ("incident_rate", "injury_rate", "death_rate", "vehicles_per_incident")

# Report headers: our column -> its name in the written report, in report order.

INCIDENT_NAMES = {
    "area": "Zip_code",
    "incidents": "Total_accidents",
    "vehicles": "Total_vehicles_in_accidents",
    "injured": "Total_persons_injured",
    "killed": "Total_persons_killed",
    "pedestrians_injured_label": "Total_pedestrians_injured",
    "pedestrians_killed_label": "Total_pedestrians_killed",
    "cyclists_injured_label": "Total_cyclists_injured",
    "cyclists_killed_label": "Total_cyclists_killed",
    "motorists_injured_label": "Total_motorists_injured",
    "motorists_killed_label": "Total_motorists_killed",
    **{f"factor_{i}": f"Top_factor_{i}" for i in range(1, 6)},
    **{f"vehicle_{i}": f"Top_vehicle_type_{i}" for i in range(1, 6)},
}

REQUEST_NAMES = {
    "area": "Zip_code",
    "requests": "Total_complaints",
    **{f"complaint_{i}": f"Top_complaint_{i}" for i in range(1, 4)},
    **{f"descriptor_{i}": f"Top_complaint_description_{i}" for i in range(1, 6)},
    "city": "City",
}

TOTAL_NAMES = {"category": "Category", "n": "Count", "kind": "Kind"}
VOLUME_NAMES = {"area": "Zip_code", "volume": "Sample_traffic_volume", "samples": "Number_of_samples"}
EXPOSURE_NAMES = {"area": "Zip_code", "exposure": "Vehicle_count_2012_2013"}

SCORECARD_NAMES = {
    "city": "City",
    "area": "Zip_Code",
    "incident_rate": "Accidents_Per_1000_Vehicles",
    "injury_rate": "Injuries_Per_1000_Accidents",
    "death_rate": "Deaths_Per_1000_Accidents",
    "vehicles_per_incident": "Vehicles_Involved_Per_Accident",
    "incidents": "Total_Number_of_Accidents",
    "vehicles": "Total_Number_of_Vehicles_Involved_in_Accidents",
    **{f"factor_{i}": f"Top_Factor_{i}" for i in range(1, 6)},
    **{f"vehicle_{i}": f"Most_Common_Vehicle_Type_{i}" for i in range(1, 6)},
    **{f"complaint_{i}": f"Top_Street_Complaint_{i}" for i in range(1, 4)},
    **{f"descriptor_{i}": f"Top_Complaint_Description_{i}" for i in range(1, 6)},
    "requests": "Total Street Complaints",
}

RATED_NAMES = {
    "city": "City",
    "area": "Zip_Code",
    "rating": "Safety_classifier",
    "incident_rate": "Accidents_per_1000_veh",
    "injury_rate": "Injuries_per_1000_accidents",
    "death_rate": "Deaths_per_1000_accidents",
    "vehicles_per_incident": "Vehicles_involved_per_accident",
    "incidents": "Total_num_accidents",
    "vehicles": "Total_num_of_accident_veh",
    **{f"factor_{i}": f"Top_factor_{i}" for i in range(1, 6)},
    **{f"vehicle_{i}": f"Top_vehicle_type_{i}" for i in range(1, 6)},
    **{f"complaint_{i}": f"Top_street_complaint_{i}" for i in range(1, 4)},
    **{f"descriptor_{i}": f"Top_complaint_desc_{i}" for i in range(1, 6)},
    "requests": "Num_street_complaints",
}

RATINGS = ("Safe", "Ok", "Hazardous")

SUMMARY_NAMES = {
    "statistic": "summary",
    "incident_rate": "Accidents per 1000 vehicles",
    "injury_rate": "Injuries per 1000 accidents",
    "death_rate": "Deaths per 1000 accidents",
    "vehicles_per_incident": "Vehicles involved per accident",
}

# --- inputs -----------------------------------------------------------------

CASUALTY_COLUMNS = (
    "persons_injured",
    "persons_killed",
    "pedestrians_injured",
    "pedestrians_killed",
    "cyclists_injured",
    "cyclists_killed",
    "motorists_injured",
    "motorists_killed",
)
FACTOR_COLUMNS = tuple(f"factor_{i}" for i in range(1, 6))
VEHICLE_COLUMNS = tuple(f"vehicle_{i}" for i in range(1, 6))
HOUR_COLUMNS = tuple(f"hour_{h:02d}" for h in range(24))


def _strings(*names: str) -> list[StructField]:
    return [StructField(name, StringType()) for name in names]


INCIDENTS = StructType(
    _strings("date", "time", "borough", "area", "latitude", "longitude", "location")
    + _strings("on_street", "cross_street", "off_street")
    + [StructField(name, IntegerType(), nullable=False) for name in CASUALTY_COLUMNS]
    + _strings(*FACTOR_COLUMNS, "record_id", *VEHICLE_COLUMNS)
)

# Requests are read by position: the width of the export varies, these do not.
REQUEST_POSITIONS = {"created_at": 1, "category": 5, "descriptor": 6, "area": 8, "city": 16}

SEGMENT_COUNTS = StructType(
    _strings("record_id", "segment_id", "roadway", "from_street", "to_street", "direction", "date")
    + _strings(*HOUR_COLUMNS)
)

GAZETTEER = StructType(_strings("street", "area"))

AREA_VOLUME = StructType(
    [
        StructField("area", StringType()),
        StructField("volume", LongType(), nullable=False),
        StructField("samples", LongType(), nullable=False),
    ]
)

# --- outputs ----------------------------------------------------------------

_COUNTS = ("incidents", "vehicles", "requests")
SCORECARD = StructType(
    [
        StructField(
            name, LongType() if name in _COUNTS else DoubleType() if name in RATE_COLUMNS else StringType()
        )
        for name in SCORECARD_NAMES
    ]
)
