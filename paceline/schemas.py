"""Fixed schemas: captured documents and the tables made from them."""

from __future__ import annotations

# Captured documents (only the fields that are read).  Numbers arrive as text.
DRIVER_DOC = """
MRData struct<DriverTable:struct<Drivers:array<
    struct<driverId:string,givenName:string,familyName:string>>>>
"""

DRIVER_STANDINGS_DOC = """
MRData struct<StandingsTable:struct<StandingsLists:array<struct<DriverStandings:array<
    struct<points:string,wins:string,
           Driver:struct<driverId:string,givenName:string,familyName:string>,
           Constructors:array<struct<constructorId:string>>>>>>>>
"""

CONSTRUCTOR_STANDINGS_DOC = """
MRData struct<StandingsTable:struct<StandingsLists:array<struct<ConstructorStandings:array<
    struct<points:string,wins:string,
           Constructor:struct<constructorId:string,name:string>>>>>>>
"""

SCHEDULE_DOC = """
MRData struct<RaceTable:struct<Races:array<
    struct<round:string,raceName:string,date:string,Circuit:struct<circuitId:string>>>>>
"""

RACE_RESULTS_DOC = """
MRData struct<RaceTable:struct<Races:array<
    struct<raceName:string,date:string,Circuit:struct<circuitId:string>,
           Results:array<struct<grid:string,position:string,status:string,points:string,
               Driver:struct<driverId:string,givenName:string,familyName:string>,
               Constructor:struct<constructorId:string,name:string>>>>>>>
"""

QUALIFYING_DOC = """
MRData struct<RaceTable:struct<Races:array<
    struct<QualifyingResults:array<
        struct<position:string,Driver:struct<driverId:string>>>>>>>
"""

WEATHER_DOC = """
forecast struct<forecastday:array<struct<day:struct<
    avgtemp_c:double,daily_will_it_rain:int,daily_chance_of_rain:int,
    condition:struct<text:string>>>>>
"""

EVENT_SCHEDULE_ROW = "RoundNumber int, EventName string, EventDate date"
SESSION_RESULT_ROW = "DriverNumber string, Position double, Points double"

# Where a document was captured for; these come from its folder names.
PATH_COLUMNS = {
    "drivers": "season int",
    "driver_standings": "season int",
    "constructor_standings": "season int",
    "schedule": "season int",
    "results": "season int, round int",
    "qualifying": "season int, round int",
    "entries": "season int, circuit_id string",
    "weather": "city string, country string, forecast_date date",
    "event_schedule": "season int",
    "session_results": "season int, round int",
}

DOCUMENTS = {
    "drivers": DRIVER_DOC,
    "driver_standings": DRIVER_STANDINGS_DOC,
    "constructor_standings": CONSTRUCTOR_STANDINGS_DOC,
    "schedule": SCHEDULE_DOC,
    "results": RACE_RESULTS_DOC,
    "qualifying": QUALIFYING_DOC,
    "entries": DRIVER_DOC,
    "weather": WEATHER_DOC,
    "event_schedule": EVENT_SCHEDULE_ROW,
    "session_results": SESSION_RESULT_ROW,
}

# The 18 model inputs, in the order the model sees them (fixed values).
FEATURES = [
    "qualifying_position",
    "wins",
    "points",
    "constructor_points",
    "constructor_wins",
    "avg_finish_circuit",
    "best_finish_circuit",
    "total_points_circuit",
    "wins_circuit",
    "win_rate_circuit",
    "avg_points_last5",
    "avg_finish_last5",
    "wins_last5",
    "circuit_type_code",
    "circuit_length",
    "temperature",
    "is_wet",
    "rain_chance",
]

CIRCUIT_STATS = FEATURES[5:10]
FORM = FEATURES[10:13]
