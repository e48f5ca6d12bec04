"""Values that decide results and therefore must not drift.

Everything in this file is a fixed value: weights, limits, patterns, word
lists and output formats.  Operators take them as parameter defaults.
"""

# Case and message vocabulary
STATUS_OPEN = "rozpracovaný"
STATUS_CLOSED = "uzavřený"
INPUT = "input"
DIAGNOSIS = "diagnosis"

# Whitespace as JavaScript defines it, as the inside of a regex character class
WHITESPACE = r"\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
WHITESPACE_CHARACTERS = (
    "\t\n\x0b\f\r \u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)

# Similarity weights, in tenths of a point
MODEL_TENTHS = 30
POWER_TENTHS = 20
CODE_TENTHS = 40
SYMPTOM_TENTHS = 15
WORD_TENTHS = 3
WORD_TENTHS_MAX = 20
MIN_WORD_LENGTH = 5

# Search limits
OWN_THRESHOLD = 5
OTHER_THRESHOLD = 8
CANDIDATE_LIMIT = 200
HIT_LIMIT = 5

# Resolution and case rules
RESOLUTION_MIN = 10
RESOLUTION_MAX = 200
DESCRIPTION_MIN = 20
MIN_DISTINCT_WORDS = 2
REPEATED_CHARACTER = r"([^\n\r\u2028\u2029])\1{6,}"
CODE_PATTERN = r"^[PCBU][0-9A-F]{4}$"

# Topic rule
TOPIC_FREE_LENGTH = 80
TOPIC_CODE = r"[PCBU][0-9A-F]{4}"
TOPIC_TERMS = [
    "dpf", "egr", "adblue", "ecu", "ecm", "tcm", "abs", "esp", "eps", "can",
    "lin", "obd", "dtc", "mil", "vin", "rpm", "tdci", "ecoblue", "ecoboost",
    "scr", "nox", "def", "urea", "vgt", "egts", "maf", "map", "iac", "tps",
    "ckp", "cmp", "evap", "purge", "swirl", "pid",
]
TOPIC_UNITS = ["km", "bar", "kpa", "rpm", "psi", "mbar", "nm", "ms", "mv", "mg"]
TOPIC_DEGREES = r"\d+°[cf]"

# Rolling limits
WRITES_PER_DAY = 20
CALLS_PER_DAY = 50
TOKENS_PER_CASE = 40_000
MAX_TOKENS_DEFAULT = 4_000
MAX_TOKENS_CAP = 8_000
BLOCK_AFTER_VIOLATIONS = 3

# Scan-log decoding
CODE_LETTERS = "PCBU"
REPLY_PREFIX = {"03": "43", "07": "47"}
ADAPTER_PATTERN = r"(?i)ELM ?327|OBDII"
CHUNK_SILENCE = "150 milliseconds"
CHUNK_CAP = "5 seconds"
CHUNK_CAP_STORED = "10 seconds"
CHUNK_CAP_PENDING = "6 seconds"
EDIT_SILENCE = "500 milliseconds"

# Answer repair: closes the fault list and fills the fields that were cut off
REPAIR_TAIL = '\n],\n"doporučené_testy":[],\n"varování":null,\n"další_info":null\n}'
INFO_CUT_MARKER = "Výsledek zkrácen."
OFF_TOPIC_FAULT = "Nesouvisející dotaz"

# Titles
DEFAULT_TITLE = "Nový případ"
DEFAULT_VEHICLE = "Vozidlo"
UNKNOWN_MODEL = "Neznámý model"
CLOUD_PREFIX = "[Cloud] "

# Texts of the verdict codes
REASON_TEXT = {
    "missing": "Chybí popis provedené opravy.",
    "too_short": "Popis opravy je příliš krátký (%d znaků, minimum 10).",
    "too_long": "Popis opravy je příliš dlouhý (%d znaků, maximum 200).",
    "repeated_character": "Popis opravy obsahuje opakující se znaky.",
    "too_few_words": "Popis opravy je příliš stručný — přidejte alespoň 2 různá slova.",
    "no_signal": "Případ musí obsahovat OBD kód, příznak nebo popis problému (alespoň 20 znaků).",
    "bad_code": "Neplatný formát OBD kódu: %s",
    "no_model": "Případ musí mít vybraný model vozidla.",
}

# Texts of the scan-log error classes
SCAN_ERROR_TEXT = {
    "no_connection": "Není spojení s vozidlem — zapněte zapalování (klíč do polohy ON)",
    "can_error": "CAN chyba — zkontrolujte zapnutí zapalování",
    "bus_busy": "Sběrnice obsazena — zkuste znovu za chvíli",
    "stopped": "Komunikace přerušena — odpojte a znovu připojte adaptér",
}

# Alert formats; the first %s of the subjects is the name of the sending system
ALERT_SUBJECT_BLOCKED = "[%s] ⛔ Instalace ZABLOKOVÁNA — %d. porušení"
ALERT_SUBJECT_WARNING = "[%s] ⚠ Porušení pravidel č. %d"
ALERT_HEADING = "<h2>%s — Porušení pravidel databáze</h2>"
ALERT_TABLE = '<table style="border-collapse:collapse;font-family:monospace">'
ALERT_CELL = '<tr><td style="padding:4px 12px 4px 0"><b>%s:</b></td><td>%s</td></tr>'
ALERT_LABELS = ["Instalace", "Důvod", "Počet porušení", "Zablokována", "Čas"]
ALERT_BLOCKED_YES = "⛔ ANO"
ALERT_BLOCKED_NO = "Ne"

# Context-block and prompt formats
STRENGTH_HIGH = "🔴 VYSOKÁ SHODA"
STRENGTH_MEDIUM = "🟡 STŘEDNÍ SHODA"
STRENGTH_PARTIAL = "🟢 ČÁSTEČNÁ SHODA"
DEFAULT_EXPERTISE = (
    "užitková vozidla pro evropský trh (EU spec), včetně systémů AdBlue, DPF Euro 5/6 a SCR"
)
CONTEXT_HEADER = "\n\nOVĚŘENÉ OPRAVY Z DATABÁZE SERVISU:\n"
CONTEXT_FOOTER = (
    "\n\nINSTRUKCE K DATABÁZI:\n"
    "- 🔴 VYSOKÁ SHODA: Toto řešení MUSÍ být na 1. nebo 2. místě — má prokázaný výsledek"
    " na velmi podobném vozidle se shodnými OBD kódy i příznaky.\n"
    "- 🟡 STŘEDNÍ SHODA: Zahrň jako pravděpodobnou variantu, uveď výše než obecné hypotézy.\n"
    "- 🟢 ČÁSTEČNÁ SHODA: Zmiň jako možnost, hodnoť volně podle ostatních příznaků.\n"
    "Pokud databázové řešení neodpovídá aktuálním příznakům, vysvětli proč se liší."
)
PROMPT_OPENING = "Jsi expertní AI diagnostika pro mechaniky specializující se na "
PROMPT_RULES = (
    "\n\nKdyž dostaneš příznaky, OBD kódy nebo popis závady, vrať POUZE validní JSON"
    " (bez textu před/za JSON):\n"
    '{"shrnutí":"...","závady":[{"název":"...","pravděpodobnost":85,"popis":"...",'
    '"příznaky_shoda":[],"obd_kódy":[],"díly":[],"postup":"...","naléhavost":"vysoká",'
    '"poznámka":"..."}],"doporučené_testy":[],"varování":null,"další_info":null}'
    "\n\nPravidla: Odpovídáš VÝHRADNĚ na otázky týkající se diagnostiky a opravy vozidel."
    " Pokud dostaneš dotaz nesouvisející s diagnostikou vozidla, vrať JSON se závadou název"
    ' "Nesouvisející dotaz" a pravděpodobností 0 a popisem "Tento systém slouží pouze pro'
    ' diagnostiku vozidel." Jinak: Když nevíš, přiznej to. 1–4 závady seřazené dle'
    " pravděpodobnosti. Naléhavost: nízká/střední/vysoká/kritická. Zohledni EU specifika"
    " (AdBlue, DPF Euro6). VRAŤ POUZE JSON."
)
