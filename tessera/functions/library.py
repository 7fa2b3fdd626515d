"""Scalar functions as SQL macros over Spark built-ins.

Each entry turns argument texts into one Spark SQL expression, so a call stays
inside Catalyst and whole-stage code generation. ``expand`` is used by the SQL
front end, ``call`` by DataFrame code. Semantics follow the documented dialect:
lengths in bytes, 1-based positions, NULL instead of an error for arguments out
of a function's domain. An argument text is put in brackets before use.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import __version__


@dataclass(frozen=True)
class Function:
    build: Callable[..., str]
    least: int
    most: int | None
    kind: str = "other"  # what the dialect may infer of the result: int, float or other


FUNCTIONS: dict[str, Function] = {}


def _add(names: str, build, least: int, most: int | None = -1, kind: str = "other") -> None:
    for name in names.split():
        FUNCTIONS[name] = Function(build, least, least if most == -1 else most, kind)


def expand(name: str, *args: str) -> str:
    """The Spark SQL expression of a call; KeyError for an unknown name."""
    f = FUNCTIONS[name.upper()]
    if len(args) < f.least or f.most is not None and len(args) > f.most:
        raise ValueError(f"{name} takes {f.least} to {f.most if f.most is not None else 'any'} arguments, not {len(args)}")
    return f"({f.build(*[f'({a})' for a in args])})"


def call(name: str, *args) -> Column:
    """A call as a Column. Arguments are SQL texts; numbers are taken as literals."""
    return F.expr(expand(name, *[str(a) for a in args]))


# ---- strings

_add("ASCII", lambda s: f"ascii({s})", 1, kind="int")
_add("CHAR_LENGTH CHARACTER_LENGTH", lambda s: f"char_length({s})", 1, kind="int")
_add("LENGTH LEN OCTET_LENGTH", lambda s: f"octet_length({s})", 1, kind="int")
_add("UPPER UCASE", lambda s: f"upper({s})", 1)
_add("LOWER LCASE", lambda s: f"lower({s})", 1)
_add("LEFT", lambda s, n: f"left({s}, greatest({n}, 0))", 2)
_add("RIGHT", lambda s, n: f"right({s}, greatest({n}, 0))", 2)


def _substr(s, pos, n=None):
    start = f"CASE WHEN {pos} < 0 THEN greatest(char_length({s}) + {pos} + 1, 1) ELSE {pos} END"
    size = f", greatest({n}, 0)" if n else ""
    return f"CASE WHEN {pos} = 0 THEN substring({s}, 1, 0) ELSE substring({s}, {start}{size}) END"


_add("SUBSTR SUBSTRING MID", _substr, 2, 3)
_add("SUBSTRING_INDEX", lambda s, d, n: f"substring_index({s}, {d}, {n})", 3)
_add("INSTR", lambda s, x: f"instr({s}, {x})", 2, kind="int")
_add("LOCATE POSITION", lambda x, s, at="1": f"locate({x}, {s}, {at})", 2, 3, "int")
_add("FIELD", lambda x, *rest: f"coalesce(array_position(array({', '.join(rest)}), {x}), 0)", 2, None, "int")
_add("FIND_IN_SET", lambda x, s: f"find_in_set({x}, {s})", 2, kind="int")
_add("CONCAT", lambda *a: f"concat({', '.join(f'CAST({x} AS STRING)' for x in a)})", 1, None)
_add("CONCAT_WS", lambda sep, *a: f"concat_ws({sep}, {', '.join(f'CAST({x} AS STRING)' for x in a)})", 2, None)
_add("LPAD", lambda s, n, p="' '": f"CASE WHEN {p} = '' THEN CASE WHEN char_length({s}) > {n} THEN left({s}, {n}) ELSE {s} END ELSE lpad({s}, {n}, {p}) END", 2, 3)
_add("RPAD", lambda s, n, p="' '": f"CASE WHEN {p} = '' THEN CASE WHEN char_length({s}) > {n} THEN left({s}, {n}) ELSE {s} END ELSE rpad({s}, {n}, {p}) END", 2, 3)
_add("LTRIM", lambda s: f"regexp_replace({s}, '^(?U)\\\\s+', '')", 1)
_add("RTRIM", lambda s: f"regexp_replace({s}, '(?U)\\\\s+$', '')", 1)
_add("TRIM", lambda s: f"regexp_replace({s}, '(?U)^\\\\s+|\\\\s+$', '')", 1)
_add("REPLACE", lambda s, a, b: f"replace({s}, {a}, {b})", 3)
_add("REVERSE", lambda s: f"reverse({s})", 1)
_add("REPEAT", lambda s, n: f"repeat({s}, greatest({n}, 0))", 2)
_add("SPACE", lambda n: f"space(greatest({n}, 0))", 1)
_add(
    "INSERT",
    lambda s, pos, n, new: f"CASE WHEN {pos} < 1 OR {n} < 0 OR {pos} > char_length({s}) THEN {s} ELSE concat(left({s}, {pos} - 1), {new}, substring({s}, {pos} + {n})) END",
    4,
)
_add("STRCMP", lambda a, b: f"CASE WHEN {a} < {b} THEN -1 WHEN {a} > {b} THEN 1 WHEN {a} = {b} THEN 0 END", 2, kind="int")
_add("FORMAT", lambda x, d: f"format_number({x}, {d})", 2)

# ---- numbers

_D = lambda x: f"CAST({x} AS DOUBLE)"
_add("ABS", lambda x: f"abs({x})", 1)
_add("SIGN", lambda x: f"CAST(sign({x}) AS INT)", 1, kind="int")
_add("MOD", lambda a, b: f"try_mod({_D(a)}, {_D(b)})", 2, kind="float")
_add("DIV", lambda a, b: f"CASE WHEN {b} <> 0 THEN CAST({a} AS BIGINT) div CAST({b} AS BIGINT) END", 2, kind="int")
_add("CEIL CEILING", lambda x: f"ceil({_D(x)})", 1, kind="int")
_add("FLOOR", lambda x: f"floor({_D(x)})", 1, kind="int")


def _digits(d: str) -> int:
    text = d.strip("() ")
    try:
        return int(text)
    except ValueError:
        raise ValueError(f"the number of digits must be a whole-number literal, not {text}") from None


def _round(x, d="0"):
    n = _digits(d)
    return f"round({_D(x)}, {n})" if n > 0 else f"CAST(round({_D(x)}, {n}) AS BIGINT)"


def _truncate(x, d="0"):
    n = _digits(d)
    if n > 0:
        return f"sign({_D(x)}) * floor(abs({_D(x)}) * 1e{n}) / 1e{n}"
    step = 10 ** (-n)
    return f"CAST(sign({_D(x)}) * floor(abs({_D(x)}) / {step}) * {step} AS BIGINT)"


_add("ROUND", _round, 1, 2)
_add("TRUNCATE TRUNC", _truncate, 1, 2)
_add("SQRT", lambda x: f"CASE WHEN {x} >= 0 THEN sqrt({x}) END", 1, kind="float")
_add("POW POWER", lambda a, b: f"pow({a}, {b})", 2, kind="float")
_add("EXP", lambda x: f"exp({x})", 1, kind="float")
_add("LN", lambda x: f"CASE WHEN {x} > 0 THEN ln({x}) END", 1, kind="float")


def _log(a, b=None):
    if b is None:
        return f"CASE WHEN {a} > 0 THEN ln({a}) END"
    return f"CASE WHEN {a} > 0 AND {a} <> 1 AND {b} > 0 THEN ln({b}) / ln({a}) END"


_add("LOG", _log, 1, 2, "float")
_add("LOG2", lambda x: f"CASE WHEN {x} > 0 THEN log2({x}) END", 1, kind="float")
_add("LOG10", lambda x: f"CASE WHEN {x} > 0 THEN log10({x}) END", 1, kind="float")
for _name in ("SIN", "COS", "TAN", "ATAN", "DEGREES", "RADIANS"):
    _add(_name, lambda x, f=_name.lower(): f"{f}({x})", 1, kind="float")
for _name in ("ASIN", "ACOS"):
    _add(_name, lambda x, f=_name.lower(): f"CASE WHEN {x} BETWEEN -1 AND 1 THEN {f}({x}) END", 1, kind="float")
_add("ATAN2", lambda a, b: f"atan2({a}, {b})", 2, kind="float")
_add("COT", lambda x: f"CASE WHEN tan({x}) <> 0 THEN 1 / tan({x}) END", 1, kind="float")
_add("PI", lambda: "pi()", 0, kind="float")
_add("RAND RANDOM", lambda seed="": f"rand({seed})", 0, 1, "float")
_add("GREATEST", lambda *a: f"greatest({', '.join(a)})" if len(a) > 1 else a[0], 1, None)
_add("LEAST", lambda *a: f"least({', '.join(a)})" if len(a) > 1 else a[0], 1, None)

# ---- dates and times; inputs may be DATE, TIMESTAMP or ISO text, results are text where the dialect has text

_TS = lambda x: f"try_cast({x} AS TIMESTAMP)"
_DATE = lambda x: f"try_cast({x} AS DATE)"
_ISO_DATE = lambda x: f"date_format({x}, 'yyyy-MM-dd')"

_add("NOW CURRENT_TIMESTAMP LOCALTIME LOCALTIMESTAMP SYSDATE", lambda: "date_format(current_timestamp(), 'yyyy-MM-dd HH:mm:ss')", 0)
_add("CURDATE CURRENT_DATE", lambda: "date_format(current_date(), 'yyyy-MM-dd')", 0)
_add("CURTIME CURRENT_TIME", lambda: "date_format(current_timestamp(), 'HH:mm:ss')", 0)
_add("DATE", lambda x: _ISO_DATE(_DATE(x)), 1)
_add("TIME", lambda x: f"date_format({_TS(x)}, 'HH:mm:ss')", 1)
for _name, _call in {"YEAR": "year", "MONTH": "month", "DAY": "day", "DAYOFMONTH": "day", "DAYOFWEEK": "dayofweek", "WEEKDAY": "weekday", "DAYOFYEAR": "dayofyear", "QUARTER": "quarter"}.items():
    _add(_name, lambda x, f=_call: f"{f}({_DATE(x)})", 1, kind="int")
for _name in ("HOUR", "MINUTE", "SECOND"):
    _add(_name, lambda x, f=_name.lower(): f"{f}({_TS(x)})", 1, kind="int")
_add("MICROSECOND", lambda x: f"CAST(date_format({_TS(x)}, 'SSSSSS') AS INT)", 1, kind="int")
_add("DAYNAME", lambda x: f"date_format({_DATE(x)}, 'EEEE')", 1)
_add("MONTHNAME", lambda x: f"date_format({_DATE(x)}, 'MMMM')", 1)
_WEEK = lambda x: f"CAST(ceil(dayofyear({_DATE(x)}) / 7) AS INT)"
_add("WEEK WEEKOFYEAR", _WEEK, 1, kind="int")
_add("YEARWEEK", lambda x: f"year({_DATE(x)}) * 100 + {_WEEK(x)}", 1, kind="int")
_add("DATE_ADD ADDDATE", lambda x, n: _ISO_DATE(f"date_add({_DATE(x)}, CAST({n} AS INT))"), 2)
_add("DATE_SUB SUBDATE", lambda x, n: _ISO_DATE(f"date_sub({_DATE(x)}, CAST({n} AS INT))"), 2)

def _seconds(t: str) -> str:
    """Seconds of a time text ``[-]HH:MM:SS``, of a timestamp text, or of a timestamp, within its day."""
    text = f"CASE WHEN instr(CAST({t} AS STRING), ' ') > 0 THEN split_part(CAST({t} AS STRING), ' ', 2) ELSE CAST({t} AS STRING) END"
    part = lambda k: f"coalesce(try_cast(nullif(split_part(split_part(ltrim('-', {text}), ':', {k}), '.', 1), '') AS BIGINT), 0)"
    return f"(CASE WHEN {t} IS NULL THEN NULL ELSE (CASE WHEN left({text}, 1) = '-' THEN -1 ELSE 1 END) * ({part(1)} * 3600 + {part(2)} * 60 + {part(3)}) END)"


def _clock(seconds: str) -> str:
    """``[-]HH:MM:SS`` of a number of seconds."""
    a = f"abs({seconds})"
    return f"concat(CASE WHEN {seconds} < 0 THEN '-' ELSE '' END, lpad(CAST({a} div 3600 AS STRING), greatest(2, length(CAST({a} div 3600 AS STRING))), '0'), ':', lpad(CAST({a} div 60 % 60 AS STRING), 2, '0'), ':', lpad(CAST({a} % 60 AS STRING), 2, '0'))"


def _shift(x: str, t: str, sign: str) -> str:
    moved = _clock(f"pmod({_seconds(x)} {sign} {_seconds(t)}, 86400)")
    text = f"CAST({x} AS STRING)"
    return f"CASE WHEN instr({text}, ' ') > 0 THEN concat(split_part({text}, ' ', 1), ' ', {moved}) ELSE {moved} END"


_add("ADDTIME", lambda x, t: _shift(x, t, "+"), 2)
_add("SUBTIME", lambda x, t: _shift(x, t, "-"), 2)
_add("DATEDIFF", lambda a, b: f"datediff({_DATE(a)}, {_DATE(b)})", 2, kind="int")
_add("TIMEDIFF", lambda a, b: _clock(f"({_seconds(a)} - {_seconds(b)})"), 2)
_add("TO_DAYS", lambda x: f"unix_date({_DATE(x)}) + 719163", 1, kind="int")
_add("FROM_DAYS", lambda n: _ISO_DATE(f"date_from_unix_date(CAST({n} AS INT) - 719163)"), 1)
_add("TIME_TO_SEC", _seconds, 1, kind="int")
_add("SEC_TO_TIME", lambda n: _clock(f"CAST({n} AS BIGINT)"), 1)
_add("MAKEDATE", lambda y, d: f"CASE WHEN {d} >= 1 THEN {_ISO_DATE(f'date_add(make_date({y}, 1, 1), CAST({d} AS INT) - 1)')} END", 2)
_add("MAKETIME", lambda h, m, s: f"CASE WHEN {m} BETWEEN 0 AND 59 AND {s} BETWEEN 0 AND 59 THEN {_clock(f'CAST({h} * 3600 + {m} * 60 + {s} AS BIGINT)')} END", 3)
_add(
    "TIMESTAMP",
    lambda d, t=None: f"date_format({_TS(d)}, 'yyyy-MM-dd HH:mm:ss')" if t is None else f"concat({_ISO_DATE(_DATE(d))}, ' ', CAST({t} AS STRING))",
    1,
    2,
)
_add("LAST_DAY", lambda x: _ISO_DATE(f"last_day({_DATE(x)})"), 1)
_PERIOD = lambda p: f"({p} div 100 * 12 + {p} % 100 - 1)"
_add("PERIOD_ADD", lambda p, n: f"({_PERIOD(p)} + {n}) div 12 * 100 + ({_PERIOD(p)} + {n}) % 12 + 1", 2, kind="int")
_add("PERIOD_DIFF", lambda a, b: f"{_PERIOD(a)} - {_PERIOD(b)}", 2, kind="int")

# Fixed values: % codes of date formats and Spark's pattern letters.
DATE_CODES = {
    "Y": "yyyy", "y": "yy", "m": "MM", "c": "M", "d": "dd", "e": "d", "H": "HH", "k": "H", "h": "hh", "I": "hh", "l": "h", "i": "mm", "M": "MMMM", "b": "MMM",
    "s": "ss", "S": "ss", "f": "SSSSSS", "p": "a", "r": "hh:mm:ss a", "T": "HH:mm:ss", "W": "EEEE", "a": "EEE", "j": "DDD", "%": "%",
}


def date_pattern(codes: str) -> str:
    """A % format as a Spark pattern. %M is a month's name, or the minute right after an hour and a colon."""
    out, at, plain = [], 0, ""

    def close() -> None:
        nonlocal plain
        if plain:
            quoted = plain.replace("'", "''")
            out.append(f"'{quoted}'" if any(c.isalpha() or c in "'#[]{}" for c in plain) else plain)
        plain = ""

    while at < len(codes):
        if codes[at] == "%" and at + 1 < len(codes):
            code = codes[at + 1]
            letters = "mm" if code == "M" and at >= 3 and codes[at - 3 : at] in ("%H:", "%I:", "%h:", "%k:") else DATE_CODES.get(code)
            if letters is None or code == "%":
                plain += code
            else:
                close()
                out.append(letters)
            at += 2
        else:
            plain += codes[at]
            at += 1
    close()
    return "".join(out)


def _literal(text: str) -> str | None:
    inner = text.strip()
    while inner.startswith("(") and inner.endswith(")"):
        inner = inner[1:-1].strip()
    return inner[1:-1].replace("''", "'") if len(inner) >= 2 and inner[0] == inner[-1] == "'" else None


def _date_format(a: str, b: str) -> str:
    """Either order: the format is the literal that holds a %."""
    for fmt, value in ((_literal(b), a), (_literal(a), b)):
        if fmt is not None and "%" in fmt:
            pattern = date_pattern(fmt).replace("'", "\\'")
            clock = f"try_cast(CASE WHEN CAST({value} AS STRING) RLIKE '^[0-9]{{1,2}}:' THEN concat('1970-01-01 ', CAST({value} AS STRING)) ELSE CAST({value} AS STRING) END AS TIMESTAMP)"
            return f"date_format({clock}, '{pattern}')"
    raise ValueError("a date format must be a literal with % codes")


_add("DATE_FORMAT STRFTIME TIME_FORMAT", _date_format, 2)


def _str_to_date(s: str, fmt: str) -> str:
    codes = _literal(fmt)
    if codes is None:
        raise ValueError("a date format must be a literal")
    pattern = date_pattern(codes).replace("'", "\\'")
    timed = any(x in codes for x in ("%H", "%h", "%k", "%I", "%i", "%s", "%S", "%T", "%r"))
    return f"date_format(try_to_timestamp({s}, '{pattern}'), '{'yyyy-MM-dd HH:mm:ss' if timed else 'yyyy-MM-dd'}')"


_add("STR_TO_DATE", _str_to_date, 2)

# ---- system and control

_add("VERSION", lambda: f"'{__version__}'", 0)
_add("DATABASE CURRENT_DATABASE SCHEMA", lambda: "'root'", 0)
_add("USER CURRENT_USER SESSION_USER SYSTEM_USER", lambda: "'root'", 0)
_add("CONNECTION_ID", lambda: "1", 0, kind="int")
_add("LAST_INSERT_ID", lambda: "0", 0, kind="int")
_add(
    "TYPEOF",
    lambda x: f"CASE WHEN {x} IS NULL THEN 'null' WHEN typeof({x}) IN ('tinyint', 'smallint', 'int', 'bigint', 'boolean') THEN 'integer' "
    f"WHEN typeof({x}) IN ('float', 'double') OR typeof({x}) LIKE 'decimal%' THEN 'real' WHEN typeof({x}) = 'string' THEN 'text' "
    f"WHEN typeof({x}) = 'binary' THEN 'blob' WHEN typeof({x}) LIKE 'array<%' THEN 'vector' ELSE typeof({x}) END",
    1,
)
_add("IF IIF", lambda c, a, b: f"if(coalesce(CAST({c} AS BOOLEAN), false), {a}, {b})", 3)
_add("IFNULL NVL", lambda a, b: f"coalesce({a}, {b})", 2)
_add("NULLIF", lambda a, b: f"nullif({a}, {b})", 2)
_add("COALESCE", lambda *a: f"coalesce({', '.join(a)})", 1, None)
_add("ISNULL", lambda x: f"CAST(isnull({x}) AS INT)", 1, kind="int")
_add("BIN", lambda x: f"bin(CAST({x} AS BIGINT))", 1)


def _conv(n, a, b):
    text = f"CAST({n} AS STRING)"
    return f"CASE WHEN {a} BETWEEN 2 AND 36 AND {b} BETWEEN 2 AND 36 THEN concat(CASE WHEN left({text}, 1) = '-' THEN '-' ELSE '' END, conv(ltrim('-', {text}), {a}, {b})) END"


_add("CONV", _conv, 3)
