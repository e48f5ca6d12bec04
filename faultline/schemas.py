"""Explicit schemas; nothing in this package is read with inference."""

VEHICLE = "struct<brand string, model string, mileage string, enginePower string>"

MESSAGE = (
    "struct<id string, type string, symptoms array<string>, obdCodes array<string>,"
    " text string, timestamp string, result string, ragMatchIds array<string>,"
    " tokensUsed bigint>"
)

CASE_DOCUMENT = (
    "id string, name string, status string, createdAt string, closedAt string,"
    f" vehicle {VEHICLE}, messages array<{MESSAGE}>, resolution string,"
    " tokenCount bigint, installationId string"
)

CORPUS_ROW = (
    "id string, local_id string, installation_id string, user_id string,"
    " vehicle_brand string, vehicle_model string, mileage int, engine_power string,"
    " symptoms array<string>, obd_codes array<string>, description string,"
    " resolution string, closed_at timestamp, created_at timestamp"
)

SEARCH_QUERY = (
    f"query_id string, installation_id string, vehicle {VEHICLE},"
    " symptoms array<string>, obdCodes array<string>, text string"
)

SESSION_ROW = (
    "id string, user_id string, data string, status string,"
    " created_at timestamp, updated_at timestamp"
)

USAGE_ROW = (
    "installation_id string, model string, input_tokens bigint, output_tokens bigint,"
    " created_at timestamp"
)

VIOLATION_ROW = (
    "id string, installation_id string, reason string, violation_count int,"
    " blocked boolean, created_at timestamp"
)

SCAN = "scan_id bigint, mode string, raw string"

CATALOG = (
    "brand string, position int, active boolean, expertise string,"
    " models array<struct<group string, label string, powers array<string>>>"
)

FAULT = (
    "struct<`název` string, `pravděpodobnost` int, popis string,"
    " `příznaky_shoda` array<string>, `obd_kódy` array<string>, `díly` array<string>,"
    " postup string, `naléhavost` string, `poznámka` string>"
)

ANSWER = (
    f"`shrnutí` string, `závady` array<{FAULT}>, `doporučené_testy` array<string>,"
    " `varování` string, `další_info` string"
)
