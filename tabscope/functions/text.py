"""Text rules: boolean words, date formats, column-name words."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: they decide results and must stay as they are -----------------------------
BOOLEAN_TOKENS = ["true", "false", "t", "f", "yes", "no", "y", "n", "0", "1"]
BOOLEAN_SHARE = 0.98

# (Spark pattern, shape of the text it accepts), in the order in which they are tried.
DATE_FORMATS = [
    ("yyyy-M-d", r"^\d{4}-\d{1,2}-\d{1,2}$"),
    ("yyyy-M-d H:m:s", r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"),
    ("d/M/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("M/d/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("yyyy-M-d'T'H:m:s", r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}$"),
    ("yyyy-M-d'T'H:m:s'Z'", r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}Z$"),
    ("d-M-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"),
    ("M-d-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"),
]
DATE_SHARE = 0.9

# Month names, their three-letter forms, and weekday names, as they occur in dates.
MONTHS = "january february march april may june july august september october november december".split()
WEEKDAYS = "monday tuesday wednesday thursday friday saturday sunday".split()

NAME_PREFIX_BONUS = (["is_", "has_", "was_", "will_"], 2.5)
NAME_WORD_SCORES = [
    (["churn", "default", "fraud", "spam", "success", "win", "lose", "click", "convert", "closed", "won", "lost"], 3.0),
    (["class", "label", "target", "y", "outcome", "result"], 2.5),
    (["price", "amount", "revenue", "sales", "profit", "loss", "score", "rating", "cost", "value", "age", "count",
      "qty", "quantity"], 2.5),
    (["id", "uuid", "guid", "pk", "hash", "session", "token", "user_id", "customer_id", "invoice_id"], -4.0),
    (["name", "title", "description", "address", "street", "postal", "zipcode", "zip", "email", "phone"], -1.5),
    (["date", "time", "timestamp", "ts", "created", "updated"], -1.0),
]
ID_MARKERS = ["id", "uuid", "guid", "code", "pk", "hash", "no", "number", "index"]
ID_NOTE_NAMES = ["id", "uuid", "pk", "primary_key"]
# ---------------------------------------------------------------------------------------------

# Dates in other forms are read by the shape of the text: every part of it becomes a token, and only the tokens count.
#   Y four digits   N one or two digits   C eight digits   B a month's name   .F a fraction of a second   P am or pm   Z a zone
# A shape names its format but for one choice: of two small numbers before a year, the month or the day may come first.
DATE_SHAPES = (r"^(?:Y([-/.])N\1N|C|N([-/.])N\2[YN]|N[ -]B,?[ -]Y|B N,? Y)"
               r"(?:[T ]N:N(?::N(?:\.F)?)?P?Z?)?$")
MONTH_FIRST, DAY_FIRST = len(DATE_FORMATS), len(DATE_FORMATS) + 1  # readings of such shapes, after the listed formats
#: Text longer than this is grouped by its digest before it is looked at; no shape is as long.
MAX_DATE_LENGTH = 64


def is_boolean_token(ref: str) -> str:
    """One of the words, in either case, with any white space around it; one pattern, since trimming costs far more."""
    space = r"[ \t\r\n\x0b\x0c]*+"
    return f"({ref} RLIKE r'\\A{space}(?i:{'|'.join(BOOLEAN_TOKENS)}){space}\\z')"


def parsed_date(ref: str, format_index: int) -> str:
    """Timestamp for one listed format, NULL where the text has another shape or is no date.

    The shape test comes first: it is cheap, and a failed parse is not.
    """
    pattern, shape = DATE_FORMATS[format_index]
    return f"CASE WHEN {ref} RLIKE r'{shape}' THEN try_to_timestamp({ref}, r\"{pattern}\") END"


def _names(words: list[str], tail: str) -> str:
    return "(?i)(?:" + "|".join(f"{w[:3]}(?:{w[3:]})?" if w[3:] else w for w in words) + ")" + tail


def date_steps(ref: str, near: str) -> list[dict[str, str]]:
    """Columns to add one step after another, since each uses the ones before it, for texts where ``near`` holds.

    ``shape`` are the tokens of the text, NULL where a listed format has the text's shape; ``form`` the same if it is one of
    :data:`DATE_SHAPES`; ``month_first`` and ``day_first`` the timestamps so read, NULL where it is no date; zones are taken off.
    Most are plain columns, for generated code; the array of numbers, made by a function, cuts that code in two, since the JVM
    compiles no method of more than 8,000 bytes.
    """
    def replaced(text: str, *steps: tuple[str, str]) -> str:
        for pattern, token in steps:
            text = f'regexp_replace({text}, r"{pattern}", "{token}")'
        return text

    listed = "|".join(dict.fromkeys(f for _, f in DATE_FORMATS))
    # The look ahead tells most places from a month's name by one letter.
    month = r"(?<![A-Za-z])(?=[ADFJMNOSadfjmnos])" + _names(MONTHS, "")
    words = replaced(ref, ("^" + _names(WEEKDAYS, r"\.?,? "), ""), (month + r"\b\.?", "B"))
    times = replaced("_words", (r"(:[0-9]{2}(?:\.[0-9]{1,9})?(?: ?[AaPp][Mm])?) ?(?:Z|UTC|GMT|[+-][0-9]{2}:?[0-9]{2})$", "$1Z"),
                     (r"(:[0-9]{2}:[0-9]{2})\.[0-9]{1,9}", "$1.F"), (r"(:[0-9]{2}(?:\.F)?) ?[AaPp][Mm]", "$1P"))
    shape = replaced("_times", *((rf"(?<![0-9])[0-9]{{{n}}}(?![0-9])", token) for n, token in (("8", "C"), ("4", "Y"), ("1,2", "N"))))

    digits = f"CASE WHEN form LIKE 'C%' THEN concat_ws(' ', left({ref}, 4), substr({ref}, 5, 2), substr({ref}, 7)) ELSE {ref} END"
    name = f'lower(left(regexp_extract({ref}, r"{month}", 0), 3))'
    by_name = f"CAST((instr('{''.join(m[:3] for m in MONTHS)}', {name}) + 2) div 3 AS INT)"
    short = f"{ref} RLIKE '^[0-9]+.[0-9]+.[0-9]{{2}}(?![0-9])'"  # a short year has two digits
    zone = f"CASE WHEN form LIKE '%Z' THEN regexp_extract({ref}, '[+-][0-9]{{2}}:?[0-9]{{2}}$', 0) ELSE '' END"
    hour = (f"CASE WHEN form NOT LIKE '%:%' THEN 0 WHEN form NOT LIKE '%P%' THEN _t "
            f"WHEN _t BETWEEN 1 AND 12 THEN _t % 12 + IF(lower({ref}) RLIKE '[0-9] ?pm', 12, 0) END")
    second = f"IF(form LIKE '%:N:N%', get(_n, IF(_named, 4, 5)), 0)"
    fraction = f"IF(form LIKE '%.F%', CAST(concat('0', regexp_extract({ref}, ':[0-9]{{2}}:[0-9]{{2}}([.][0-9]{{1,6}})', 1)) AS DECIMAL(8, 6)), 0)"
    shift = ("IF(_zone <> '', IF(left(_zone, 1) = '-', -1, 1) * "
             "(60 * CAST(substr(_zone, 2, 2) AS INT) + CAST(right(_zone, 2) AS INT)), 0)")

    def moment(month: str, day: str) -> str:  # what is out of range is told first: a failed construction is not cheap
        made = f"try_make_timestamp(_full, {month}, {day}, _hour, _minute, IF(_second < 60, _second + _fraction, NULL))"
        return (f"CASE WHEN {month} BETWEEN 1 AND 12 AND {day} BETWEEN 1 AND 31 AND _hour < 24 AND _minute < 60 AND _full <= 9999 "
                f"THEN IF(_shift = 0, {made}, timestampadd(MINUTE, -_shift, {made})) END")

    known = "form IS NOT NULL"
    return [
        {"_words": f"CASE WHEN {near} AND NOT {ref} RLIKE r'{listed}' THEN IF({ref} RLIKE '[A-Za-z]{{3}}', {words}, {ref}) END"},
        {"_times": f"IF(contains(_words, ':'), {times}, _words)"},
        {"shape": shape},
        {"form": f"CASE WHEN shape RLIKE r'{DATE_SHAPES}' THEN shape END"},
        {"_n": f"CASE WHEN {known} THEN transform(regexp_extract_all({digits}, '[0-9]+', 0), n -> try_cast(n AS INT)) END",
         "_named": "form LIKE '%B%'", "_year_first": "form LIKE 'Y%' OR form LIKE 'C%'", "_zone": zone},
        # Places of year, month and day among the numbers; a month's name is none of them.
        {"_n0": "get(_n, 0)", "_n1": "get(_n, 1)", "_n2": "get(_n, 2)", "_t": "get(_n, IF(_named, 2, 3))", "_shift": shift,
         "_minute": f"IF(form LIKE '%:%', get(_n, IF(_named, 3, 4)), 0)", "_second": second, "_fraction": fraction},
        {"_year": "CASE WHEN _named THEN _n1 WHEN _year_first THEN _n0 ELSE _n2 END", "_hour": hour,
         "_month": f"CASE WHEN _named THEN {by_name} WHEN _year_first THEN _n1 ELSE _n0 END",
         "_day": "CASE WHEN _named THEN _n0 WHEN _year_first THEN _n2 ELSE _n1 END"},
        {"_full": f"CASE WHEN form NOT RLIKE '^N.N.N' THEN _year WHEN {short} THEN _year + IF(_year < 69, 2000, 1900) END"},
        {"month_first": f"CASE WHEN {known} THEN {moment('_month', '_day')} END",
         "day_first": f"CASE WHEN form RLIKE '^N.N.[YN]' THEN {moment('_day', '_month')} END"},
    ]


def looks_like_date(ref: str) -> str:
    """Cheap necessary condition for any of the listed formats and shapes."""
    begins = "|".join(w[:3] for w in MONTHS + WEEKDAYS)
    return (f"(length({ref}) <= {MAX_DATE_LENGTH} AND {ref} RLIKE r'^(?:[0-9]{{1,4}}[-/. ][0-9A-Za-z]|[0-9]{{8}}(?:[T ]|$)|(?i:{begins}))')")


def contains_word(text: Column, words: list[str]) -> Column:
    # (?U): \b follows Unicode letters, so a word inside an accented word does not count.
    return text.rlike(r"(?U)\b(" + "|".join(words) + r")\b")


def name_score(name: Column) -> Column:
    """Sum of every bonus and penalty whose words occur in the lower-cased name."""
    text = F.lower(name)
    prefixes, bonus = NAME_PREFIX_BONUS
    starts = reduce(lambda a, b: a | b, [text.startswith(p) for p in prefixes])
    parts = [F.when(starts, F.lit(bonus)).otherwise(F.lit(0.0))]
    for words, weight in NAME_WORD_SCORES:
        parts.append(F.when(contains_word(text, words), F.lit(weight)).otherwise(F.lit(0.0)))
    return reduce(add, parts)


def has_id_marker(name: Column) -> Column:
    """True when the lower-cased name holds an identifier marker anywhere, also inside a word."""
    return F.lower(name).rlike("|".join(ID_MARKERS))
