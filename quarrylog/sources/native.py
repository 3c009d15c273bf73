"""Line parsers as Column expressions over the columns raw and provenance.

with_text and with_json cover the common shape of a line and are null for others, which go to the Python parsers; with_rfc5424
covers every line. An event is a struct: error, message, level, timestamp, source, fields (values as JSON texts). What an event's parts
share (tokens, the parsed record) is a column of its own first, so that it is computed once a line.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylog.sources import levels as L

EVENT = "struct<error: string, message: string, level: string, timestamp: timestamp, source: string, fields: map<string, string>>"
_DATE, _TIME = r"[0-9]{4}-[0-9]{2}-[0-9]{2}", r"[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]{1,6})?"
_OFFSET = r"Z|[+-](?:[01][0-9]|2[0-3]):[0-5][0-9]"
_MOMENT = f"^(?!0000){_DATE}[T ]{_TIME}(?:{_OFFSET})?$"


def _names(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def level_names() -> Column:
    """Map of upper-case severity names to levels."""
    return _names({**{x: x for x in L.LEVELS}, **L.ALIASES})


def _level(name: Column) -> Column:
    return F.coalesce(F.try_element_at(level_names(), F.upper(name)), F.lit(L.UNKNOWN))


def moment(text: Column) -> Column:
    """The timestamp of a canonical ISO text (UTC where it has no offset), else null."""
    zoned = text.endswith("Z") | F.substring(text, -6, 1).isin("+", "-")
    plain = F.when(zoned, text).otherwise(F.concat(text, F.lit("Z"))).try_cast("timestamp")
    # a cast takes offsets up to 18 hours; larger ones are subtracted by hand
    body, offset = F.substring(text, F.lit(1), F.length(text) - 6), F.substring(text, -6, 6)
    minutes = (F.substring(offset, 2, 2).try_cast("int") * 60 + F.substring(offset, 5, 2).try_cast("int")).cast("long")
    shift = F.when(F.substring(offset, 1, 1) == "-", -1).otherwise(1) * minutes * 60_000_000
    far = F.timestamp_micros(F.unix_micros(F.concat(body, F.lit("Z")).try_cast("timestamp")) - shift)
    return F.when(text.rlike(_MOMENT), F.when(text.rlike("[+-](?:1[89]|2[0-3]):[0-9]{2}$"), far).otherwise(plain))


def _event(message: Column, level: Column, timestamp: Column, source: Column, fields: Column, error: Column | None = None) -> Column:
    parts = {"error": error if error is not None else F.lit(None), "message": message, "level": level, "timestamp": timestamp, "source": source, "fields": fields}
    return F.struct(*(c.alias(n) for n, c in parts.items())).cast(EVENT)


# --- text ----------------------------------------------------------------------------------------------------------------


_UNQUOTED = r"""[^\s'"]|"[^"]*+"|'[^']*+'"""
_BALANCED = r"""^(?:[^'"]++|"[^"]*+"|'[^']*+')*+$"""
_EDGES = r"""[\[\],'"]+"""


def with_text(lines: DataFrame, name: str) -> DataFrame:
    """Lines of printable ASCII without backslashes, whose leading time, if any, and whose time keys are canonical."""
    plain = F.col("raw").rlike(r"^[\t\r\n\x20-\x7e&&[^\\]]*$")
    line = F.when(plain, F.regexp_replace("raw", r"[\r\n]+$", ""))
    split = lambda c: F.filter(F.split(c, r"[ \t\r\n]+"), lambda t: t != "")
    staged = lines.withColumn("_line", line).withColumns({"_plain": split(F.col("_line")), "_words": split(F.translate("_line", "[]:", "   "))})
    # quotes that aren't closed are characters like others
    quoted = F.col("_line").rlike(r"""['"]""") & F.col("_line").rlike(_BALANCED)
    unquoted = F.transform(F.regexp_extract_all("_line", F.lit(f"(?:{_UNQUOTED})+"), F.lit(0)), lambda t: F.regexp_replace(t, r"""["]([^"]*+)["]|[']([^']*+)[']""", "$1$2"))
    staged = staged.withColumn("_tokens", F.when(quoted, unquoted).otherwise(F.col("_plain")))
    tokens, words = F.col("_tokens"), F.col("_words")
    bare = lambda t: F.regexp_replace(t, r"^[\[\]]+|[\[\]]+$", "")
    staged = staged.withColumns({"_1": bare(F.get("_plain", F.lit(0))), "_2": bare(F.get("_plain", F.lit(1)))})
    first, second = F.col("_1"), F.col("_2")
    two = first.rlike(f"^{_DATE}$") & second.rlike(f"^{_TIME}(?:{_OFFSET})?$")
    staged = staged.withColumn("_time", F.when(two, F.concat(first, F.lit("T"), second)).when(first.rlike(_MOMENT), first))
    trim = lambda c: F.btrim(c, F.lit(" \t\r\n"))
    key = lambda t: trim(F.substring_index(t, "=", 1))
    after = lambda t: F.substring(t, F.instr(t, "=") + 1, F.length(t))
    value = lambda t: F.regexp_replace(after(t), f"^{_EDGES}|{_EDGES}$", "")
    keyed = lambda t, keys: t.contains("=") & F.lower(key(t)).isin(*keys)
    named = lambda t: F.try_element_at(level_names(), F.upper(F.when(keyed(t, L.TEXT_LEVEL_KEYS), trim(value(t))).otherwise(t)))
    level = F.coalesce(F.get(F.filter(F.transform(words, named), lambda x: x.isNotNull()), F.lit(0)), F.lit(L.UNKNOWN))
    sources = F.filter(F.transform(F.filter(tokens, lambda t: keyed(t, L.SOURCE_KEYS)), lambda t: trim(value(t))), lambda v: v != "")
    staged = staged.withColumn("_times", F.transform(F.filter(tokens, lambda t: keyed(t, L.TEXT_TIME_KEYS)), value))
    staged = staged.withColumn("_pairs", F.filter(tokens, lambda t: t.contains("=") & (key(t) != "") & ~F.lower(key(t)).isin(*L.TEXT_RESERVED_KEYS)))
    keys = F.transform("_pairs", key)
    chosen = F.filter("_pairs", lambda t, k: F.array_position(keys, key(t)) == k + 1)

    def encoded(t: Column) -> Column:
        for c, escape in (('"', r"\""), ("\t", r"\t"), ("\r", r"\r"), ("\n", r"\n")):
            t = F.replace(t, F.lit(c), F.lit(escape))
        return F.concat(F.lit('"'), t, F.lit('"'))

    fields = F.map_from_entries(F.transform(chosen, lambda t: F.struct(key(t), encoded(after(t)))))
    known = F.col("_time").isNotNull() | F.coalesce(first.rlike(r"^[^0-9]"), F.lit(True)) | (first == "")
    timed = F.forall("_times", lambda v: v.rlike(_MOMENT))
    staged = staged.withColumn("_at", moment(F.col("_time")))
    at = F.coalesce("_at", F.get(F.filter(F.transform("_times", moment), lambda t: t.isNotNull()), F.lit(0)))
    good = F.col("_line").isNotNull() & known & timed & (F.col("_at").isNotNull() | ~two | two.isNull())
    event = _event(F.col("_line"), level, at, F.coalesce(F.get(sources, F.lit(0)), F.col("provenance")), fields)
    return staged.withColumn(name, F.when(good, event)).drop("_line", "_plain", "_tokens", "_words", "_1", "_2", "_time", "_times", "_pairs", "_at")


# --- JSON ----------------------------------------------------------------------------------------------------------------

_STRING = r'"(?:[^"\\]|\\.)*+"'
#: Numbers that Python writes otherwise than they stand in the line: exponents, many digits, zeros at the end, very small ones, minus zero.
_ODD_NUMBER = r"[0-9][eE]|[0-9]{31}|(?=[0-9.]{17})[0-9]+\.|\.[0-9]*0(?![0-9])|(?<![0-9])0\.0000|-0(?![.0-9])"
#: Fractions within nested values that Java writes with an exponent.
_ODD_NESTED = r"(?<![0-9])0\.00|[0-9]{7}\."
_WHOLE = "^(0|[1-9][0-9]{0,18})$"
#: What follows a record in an array, to tell that nothing else does.
_END = "<end of record>"


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _string(value: Column) -> Column:
    """A variant's text if it is a string, else null."""
    return F.when(_kind(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _whole(value: Column) -> Column:
    """A whole number, or one spelled plainly in a string, else null."""
    return F.when(_kind(value) == "BIGINT", F.try_variant_get(value, "$", "long")).otherwise(F.when(_string(value).rlike(_WHOLE), _string(value).try_cast("long")))


def _spaced(json: Column) -> Column:
    """A JSON text with a space after each comma and colon outside strings, and no other white space there."""
    bare = F.regexp_replace(json, rf"({_STRING})|[ \t\r\n]+", "$1")
    wide = F.regexp_replace(bare, rf"({_STRING}[,:]?)|(,)", "$1$2 ")
    return F.regexp_replace(wide, rf"({_STRING}) (?=[\]}}]|$)|({_STRING}[,:] )", "$1$2")


def with_json(lines: DataFrame, name: str) -> DataFrame:
    """Objects in printable ASCII without escapes but for quotes, backslashes and ends of lines, with plainly written numbers; texts, or an
    AnyValue of one text, for the message, texts for level and time, whole numbers for numbered levels and moments."""
    raw = F.col("raw")
    plain = raw.rlike(r'^[ \t\r\n]*\{(?:[\x20-\x7e\t&&[^\\]]|\\["\\nrt])*+[ \t\r\n]*$')
    numbers = F.regexp_replace(raw, _STRING, "")
    plain = plain & ~raw.contains(_END) & ~numbers.rlike(_ODD_NUMBER) & ~(numbers.rlike(_ODD_NESTED) & numbers.rlike(r"\{.*[{\[]"))
    # the parser of variants stops where a value ends, whatever comes then
    staged = lines.withColumn("_pair", F.try_parse_json(F.when(plain, F.concat(F.lit("["), raw, F.lit(f',"{_END}"]')))))
    alone = F.try_variant_get("_pair", "$[1]", "string") == _END
    staged = staged.withColumn("_record", F.when(alone, F.try_variant_get("_pair", "$[0]", "map<string,variant>"))).drop("_pair")
    record = F.col("_record")
    staged = staged.withColumn("_kinds", F.transform_values(record, lambda _, v: _kind(v)))
    kind = lambda k: F.try_element_at("_kinds", k if isinstance(k, Column) else F.lit(k))
    staged = staged.withColumn("_strings", F.transform_values(F.map_filter(record, lambda k, _: kind(k) == "STRING"), lambda _, v: F.try_variant_get(v, "$", "string")))
    value = lambda k: F.try_element_at(record, F.lit(k))
    string = lambda k: F.try_element_at("_strings", F.lit(k))
    first = lambda keys: F.coalesce(*map(value, keys))  # noqa: E731  the first key that is there, be it null
    inside = lambda v, path, kind="variant": F.try_variant_get(v, path, kind)
    staged = staged.withColumns({"_m": first(L.MESSAGE_KEYS), "_l": first(L.LEVEL_KEYS), "_t": first(L.TIME_KEYS), "_o": first(L.OBSERVED_KEYS)})
    staged = staged.withColumn("_l", F.coalesce("_l", inside(value("log"), "$.level")))
    staged = staged.withColumns({f"{c}_s": _string(F.col(c)) for c in ("_m", "_l", "_t", "_o")})

    wrapped = _kind(F.col("_m")) == "OBJECT<stringValue: STRING>"
    message = F.when(F.col("_m").isNull(), "").when(F.col("_m_s").isNotNull(), F.col("_m_s")).when(wrapped, inside(F.col("_m"), "$.stringValue", "string"))
    names = F.array(*map(F.lit, (L.UNKNOWN, *(x for x in L.SEVERITY_NUMBER_LEVELS for _ in range(4)))))
    numbered = lambda v, names: F.when(v.isNull(), L.UNKNOWN).otherwise(F.when(_whole(v).isNotNull(), F.coalesce(F.get(names, F.least(_whole(v), F.lit(1000)).cast("int")), F.lit(L.UNKNOWN))))
    by_number = F.when(value("severityNumber").isNotNull(), numbered(value("severityNumber"), names)).otherwise(numbered(value("PRIORITY"), F.array(*map(F.lit, L.PRIORITY_LEVELS))))
    named = F.when(F.col("_l_s").rlike(r"^[\x20-\x7e]*$"), _level(F.trim("_l_s")))
    level = F.when(F.col("_l").isNull(), by_number).otherwise(named)

    # the parts of a time: its micros, and whether Python has to read it
    iso = lambda c: (F.unix_micros(moment(F.col(f"{c}_s"))), F.col(c).isNotNull() & ~F.coalesce(F.col(f"{c}_s").rlike(_MOMENT), F.lit(False)))

    def unix(v: Column, nanos: bool) -> tuple[Column, Column]:
        n = _whole(v)
        if not nanos:
            return F.when(n >= 0, n), v.isNotNull() & (n.isNull() | (n >= 4_000_000_000_000_000))
        # Python divides as doubles: halves of microseconds may fall to either side
        below = n % 1000
        return F.when(n >= 0, F.call_function("div", n, F.lit(1000)) + F.when(below >= 650, 1).otherwise(0)), v.isNotNull() & (n.isNull() | below.between(351, 649))

    times = [iso("_t"), unix(value("timeUnixNano"), True), iso("_o"), unix(value("observedTimeUnixNano"), True), unix(value("__REALTIME_TIMESTAMP"), False)]
    hard = reduce(lambda a, b: a | b, (x for _, x in times))

    some = lambda v: F.nullif(F.trim(v), F.lit(""))
    attributes = F.filter(inside(inside(value("resource"), "$.attributes"), "$", "array<variant>"), lambda a: _string(inside(a, "$.key")) == "service.name")
    attribute = lambda a: F.when(_kind(inside(a, "$.value")).startswith("OBJECT"), inside(a, "$.value.stringValue")).otherwise(inside(a, "$.value"))
    sources = F.concat(
        F.array(*(string(k) for k in (*L.SOURCE_KEYS, "service.name")), _string(inside(value("service"), "$.name"))),
        F.coalesce(F.transform(attributes, lambda a: _string(attribute(a))), F.array().cast("array<string>")),
        F.array(*map(string, L.JOURNAL_SOURCE_KEYS)),
    )
    staged = staged.withColumn("_sources", sources)
    source = F.coalesce(F.get(F.filter(F.transform("_sources", some), lambda s: s.isNotNull()), F.lit(0)), F.col("provenance"))

    kept = F.map_filter(record, lambda k, _: ~k.isin(*L.RESERVED_KEYS))
    nested = lambda kind: kind.startswith("OBJECT") | kind.startswith("ARRAY")
    texts = F.when(F.exists(F.map_keys("_kept"), lambda k: nested(kind(k))), F.from_json(raw, "map<string,string>"))
    staged = staged.withColumn("_kept", kept).withColumn("_texts", texts)
    fields = F.transform_values("_kept", lambda k, v: F.when(nested(kind(k)), _spaced(F.try_element_at("_texts", k))).otherwise(F.to_json(v)))
    white = F.exists("_sources", lambda s: F.coalesce(s.rlike(r"[\t\r\n]"), F.lit(False)))
    staged = staged.withColumns({"_message": message, "_level": level})
    good = record.isNotNull() & F.col("_message").isNotNull() & F.col("_level").isNotNull() & ~hard & ~white
    event = _event(F.col("_message"), F.col("_level"), F.timestamp_micros(F.coalesce(*(t for t, _ in times))), source, fields)
    return staged.withColumn(name, F.when(good, event)).drop("_record", "_kinds", "_strings", "_m", "_l", "_t", "_o", "_m_s", "_l_s", "_t_s", "_o_s", "_sources", "_kept", "_texts", "_message", "_level")


# --- RFC 5424 --------------------------------------------------------------------------------------------------------------

_HEADER = r"(?s)^<([0-9]{1,3})>([0-9]{1,3}) (\S+) (\S+) (\S+) (\S+) (\S+) (.*)$"
_NAME = r"[\x21\x23-\x3c\x3e-\x5c\x5e-\x7e]{1,32}"
# possessive loops: Java's other loops over groups use the stack for each round
_VALUE = r'[^"\\\]]*+(?:\\["\\\]][^"\\\]]*+)*+'
_ELEMENTS = rf'(?s)^(-|(?:\[{_NAME}(?: {_NAME}="{_VALUE}")*+\])++)(?!\[)(?: (.*))?$'
_RFC_TIME = rf"^{_DATE}T{_TIME}(?:{_OFFSET})$"
# Longest header fields.
_LIMITS = {"hostname": 255, "app": 48, "procid": 128, "msgid": 32}


def with_rfc5424(lines: DataFrame, name: str) -> DataFrame:
    staged = lines.withColumn("_line", F.regexp_replace("raw", r"[\r\n]+$", ""))
    # past the header's pattern, single spaces part its fields
    staged = staged.withColumn("_parts", F.when(F.col("_line").rlike(_HEADER), F.split("_line", " ", 7)))
    part = lambda k: F.get("_parts", F.lit(k))
    staged = staged.withColumns({"_pri": F.regexp_extract(part(0), "[0-9]+", 0).try_cast("int"), "_version": F.substring_index(part(0), ">", -1), "_data": F.regexp_extract(part(6), _ELEMENTS, 1)})
    pri, version, time, data = F.col("_pri"), F.col("_version"), part(1), F.col("_data")
    header = dict(zip(_LIMITS, map(part, range(2, 6)), strict=True))
    staged = staged.withColumns({"_at": F.when(time.rlike(_RFC_TIME), moment(time)), "_rest": F.substring(part(6), F.length(data) + 2, F.length(part(6)))})
    checks = [
        (F.col("_parts").isNull(), "invalid syslog header"),
        (pri > 191, "PRI must be between 0 and 191"),
        (~version.rlike("^[1-9][0-9]{0,2}$"), "VERSION must be 1-999 without leading zeros"),
        ((time != "-") & F.col("_at").isNull(), "invalid timestamp"),
        *(((c != "-") & (F.length(c) > _LIMITS[n]), f"{n.upper()} exceeds maximum length") for n, c in header.items()),
        *(((c != "-") & ~c.rlike(r"^[\x21-\x7e]*$"), f"{n.upper()} must contain printable ASCII only") for n, c in header.items()),
        (data == "", "invalid structured data, or no space between it and the message"),
    ]
    bad = F.coalesce(*(F.when(test, text) for test, text in checks))
    rest = F.col("_rest")
    bom = rest.startswith("\ufeff")
    encode = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    severity, facility = (pri % 8).cast("int"), F.floor(pri / 8).cast("int")
    entries = [
        ("syslog_facility", facility.cast("string"), None),
        ("syslog_facility_name", encode(F.get(F.array(*map(F.lit, L.FACILITY_NAMES)), facility)), None),
        ("syslog_severity", severity.cast("string"), None),
        ("syslog_severity_name", encode(F.get(F.array(*map(F.lit, L.PRIORITY_NAMES)), severity)), None),
        ("syslog_priority", pri.cast("string"), None),
        ("syslog_version", version, None),
        ("syslog_timestamp", encode(time), time != "-"),
        ("syslog_utf8_bom", F.lit("true"), bom),
        ("syslog_structured_data", encode(data), data != "-"),
        *((f"syslog_{n}", encode(c), c != "-") for n, c in header.items()),
    ]
    kept = F.filter(F.array(*(F.when(F.lit(True) if on is None else on, F.struct(F.lit(n).alias("key"), v.alias("value"))) for n, v, on in entries)), lambda e: e.isNotNull())
    source = F.coalesce(F.nullif(header["app"], F.lit("-")), F.nullif(header["hostname"], F.lit("-")), F.col("provenance"))
    level = F.get(F.array(*map(F.lit, L.PRIORITY_LEVELS)), severity)
    event = _event(F.when(bom, F.substring(rest, 2, 1 << 30)).otherwise(rest), level, F.col("_at"), source, F.map_from_entries(kept))
    staged = staged.withColumn("_bad", bad)
    failed = _event(*(F.lit(None) for _ in range(5)), error=F.col("_bad"))
    return staged.withColumn(name, F.when(F.col("_bad").isNull(), event).otherwise(failed)).drop("_line", "_parts", "_pri", "_version", "_data", "_at", "_rest", "_bad")
