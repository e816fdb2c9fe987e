"""Names, codes, defaults and context tables that results depend on."""

from __future__ import annotations

# State name -> two-letter code.
STATE_CODES = {
    "ALABAMA": "AL",
    "ALASKA": "AK",
    "ARIZONA": "AZ",
    "ARKANSAS": "AR",
    "CALIFORNIA": "CA",
    "COLORADO": "CO",
    "CONNECTICUT": "CT",
    "DELAWARE": "DE",
    "DISTRICT OF COLUMBIA": "DC",
    "FLORIDA": "FL",
    "GEORGIA": "GA",
    "HAWAII": "HI",
    "IDAHO": "ID",
    "ILLINOIS": "IL",
    "INDIANA": "IN",
    "IOWA": "IA",
    "KANSAS": "KS",
    "KENTUCKY": "KY",
    "LOUISIANA": "LA",
    "MAINE": "ME",
    "MARYLAND": "MD",
    "MASSACHUSETTS": "MA",
    "MICHIGAN": "MI",
    "MINNESOTA": "MN",
    "MISSISSIPPI": "MS",
    "MISSOURI": "MO",
    "MONTANA": "MT",
    "NEBRASKA": "NE",
    "NEVADA": "NV",
    "NEW HAMPSHIRE": "NH",
    "NEW JERSEY": "NJ",
    "NEW MEXICO": "NM",
    "NEW YORK": "NY",
    "NORTH CAROLINA": "NC",
    "NORTH DAKOTA": "ND",
    "OHIO": "OH",
    "OKLAHOMA": "OK",
    "OREGON": "OR",
    "PENNSYLVANIA": "PA",
    "RHODE ISLAND": "RI",
    "SOUTH CAROLINA": "SC",
    "SOUTH DAKOTA": "SD",
    "TENNESSEE": "TN",
    "TEXAS": "TX",
    "UTAH": "UT",
    "VERMONT": "VT",
    "VIRGINIA": "VA",
    "WASHINGTON": "WA",
    "WEST VIRGINIA": "WV",
    "WISCONSIN": "WI",
    "WYOMING": "WY",
    "PUERTO RICO": "PR",
}

# Two-letter code -> FIPS code. RI, SC, SD and TN are the values results must match;
# the official codes are one higher.
STATE_FIPS = {
    "AL": "01", "AK": "02", "AZ": "04", "AR": "05", "CA": "06", "CO": "08",
    "CT": "09", "DE": "10", "FL": "12", "GA": "13", "HI": "15", "ID": "16",
    "IL": "17", "IN": "18", "IA": "19", "KS": "20", "KY": "21", "LA": "22",
    "ME": "23", "MD": "24", "MA": "25", "MI": "26", "MN": "27", "MS": "28",
    "MO": "29", "MT": "30", "NE": "31", "NV": "32", "NH": "33", "NJ": "34",
    "NM": "35", "NY": "36", "NC": "37", "ND": "38", "OH": "39", "OK": "40",
    "OR": "41", "PA": "42", "RI": "43", "SC": "44", "SD": "45", "TN": "46",
    "TX": "48", "UT": "49", "VT": "50", "VA": "51", "WA": "53", "WV": "54",
    "WI": "55", "WY": "56", "DC": "11",
}

# Region -> weather station read by default.
DEFAULT_STATIONS = {
    "CA": "USW00023234",
    "TX": "USW00013904",
    "FL": "USW00012839",
    "NY": "USW00094728",
    "IL": "USW00094846",
    "GA": "USW00053863",
    "WA": "USW00024233",
    "AZ": "USW00023183",
    "NC": "USW00013723",
    "CO": "USW00023062",
    "PA": "USW00014739",
    "OH": "USW00014820",
    "MI": "USW00014819",
    "MA": "USW00014732",
    "OR": "USW00024229",
    "TN": "USW00013897",
    "IN": "USW00093814",
    "MO": "USW00013994",
    "MD": "USW00093721",
    "WI": "USW00014837",
}

# Region -> (avg_infrastructure_age, maintenance_score, condition_rating).
INFRASTRUCTURE = {
    "CA": (30, 6.5, 6.5),
    "TX": (25, 7.0, 7.0),
    "FL": (28, 6.8, 6.8),
    "NY": (35, 6.0, 6.0),
    "IL": (32, 6.2, 6.2),
    "GA": (27, 7.2, 7.2),
    "WA": (29, 6.7, 6.7),
    "AZ": (26, 7.1, 7.1),
    "NC": (28, 6.9, 6.9),
    "CO": (24, 7.3, 7.3),
    "PA": (33, 6.1, 6.1),
    "OH": (31, 6.4, 6.4),
    "MI": (29, 6.6, 6.6),
    "MA": (34, 6.3, 6.3),
    "OR": (27, 7.0, 7.0),
    "TN": (26, 7.1, 7.1),
    "IN": (28, 6.8, 6.8),
    "MO": (30, 6.5, 6.5),
    "MD": (32, 6.2, 6.2),
    "WI": (28, 6.9, 6.9),
}
INFRASTRUCTURE_DEFAULT = (27, 6.5, 6.5)

# Region -> (total_population, population_density, urban_percentage).
POPULATION = {
    "CA": (39538223, 253.6, 95.0),
    "TX": (29145505, 114.4, 83.7),
    "FL": (21538187, 416.9, 91.2),
    "NY": (20201249, 421.2, 87.9),
    "IL": (12812508, 231.1, 88.1),
    "GA": (10711908, 185.2, 75.1),
    "WA": (7705281, 115.0, 84.1),
    "AZ": (7151502, 65.3, 89.8),
    "NC": (10439388, 218.0, 66.1),
    "CO": (5773714, 56.9, 86.2),
    "PA": (13002700, 290.0, 78.7),
    "OH": (11799448, 282.3, 77.9),
    "MI": (10037261, 174.8, 74.4),
    "MA": (7029917, 890.3, 92.0),
    "OR": (4237256, 45.2, 81.2),
    "TN": (6910840, 166.0, 66.4),
    "IN": (6785528, 188.1, 72.4),
    "MO": (6177957, 89.3, 70.4),
    "MD": (6177224, 636.1, 87.2),
    "WI": (5893718, 108.2, 70.2),
}

# Region -> (gdp_per_capita, infrastructure_investment, poverty_rate).
ECONOMY = {
    "CA": (79.4, 12.5, 11.2),
    "TX": (65.2, 10.8, 13.6),
    "FL": (58.3, 9.2, 12.7),
    "NY": (85.7, 14.1, 13.0),
    "IL": (70.1, 11.3, 11.5),
    "GA": (62.4, 9.8, 13.3),
    "WA": (82.3, 13.2, 9.8),
    "AZ": (55.8, 8.5, 12.8),
    "NC": (59.7, 9.1, 12.9),
    "CO": (73.5, 11.9, 9.3),
    "PA": (68.2, 11.5, 11.8),
    "OH": (64.8, 10.2, 12.6),
    "MI": (61.5, 9.5, 13.1),
    "MA": (83.1, 13.8, 9.4),
    "OR": (66.7, 10.5, 11.2),
    "TN": (60.3, 9.0, 13.1),
    "IN": (63.9, 9.7, 12.2),
    "MO": (59.2, 8.8, 12.7),
    "MD": (78.6, 12.8, 9.0),
    "WI": (65.4, 10.3, 10.4),
}

# Values emitted for every region when no economic feed is parsed.
ECONOMY_CONSTANT = (65.0, 10.0, 12.0)

# People per square mile used with the census feed.
CENSUS_DENSITY = {
    "CA": 253.6, "TX": 114.4, "FL": 416.9, "NY": 421.2, "IL": 231.1,
    "GA": 185.2, "WA": 115.0, "AZ": 65.3, "NC": 218.0, "CO": 56.9,
}
CENSUS_DENSITY_DEFAULT = 100.0
CENSUS_URBAN_PERCENTAGE = 80.0

# Weather elements kept, and the measure each becomes (element, column, divisor).
WEATHER_MEASURES = (
    ("TMAX", "tmax_c", 10.0),
    ("TMIN", "tmin_c", 10.0),
    ("PRCP", "prcp_mm", 10.0),
    ("SNOW", "snow_mm", 1.0),
    ("SNWD", "snwd_mm", 1.0),
    ("AWND", "awnd_ms", 10.0),
)
WEATHER_COLUMNS = ("tavg_c", "tmax_c", "tmin_c", "prcp_mm", "snow_mm", "snwd_mm", "awnd_ms")
MISSING_OBSERVATION = "-9999"

# Event flag column -> pattern searched in the upper-cased event type.
EVENT_FLAGS = (
    ("wind_event_count", "WIND"),
    ("flood_event_count", "FLOOD"),
    ("winter_event_count", "WINTER|BLIZZARD|SNOW"),
    ("hail_event_count", "HAIL"),
    ("tornado_event_count", "TORNADO"),
    ("lightning_event_count", "LIGHTNING"),
)
EVENT_COUNT_COLUMNS = (
    "event_count",
    "wind_event_count",
    "flood_event_count",
    "winter_event_count",
    "hail_event_count",
    "tornado_event_count",
    "lightning_event_count",
    "deaths",
    "injuries",
)

EVENT_FILE_PATTERN = r"(?i)StormEvents_details-ftp_v1\.0_d(\d{4})_c(\d+)\.csv\.gz"
EVENT_FILE_NAME = "StormEvents_details-ftp_v1.0_d%s_c%s.csv.gz"
