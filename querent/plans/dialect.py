"""Statements of a lenient embedded SQL dialect in Spark's terms: text rewrites outside of literals."""

from __future__ import annotations

import re

# Functions and their equals, date patterns.
FUNCTIONS = {"IIF": "if", "IFNULL": "ifnull", "SUBSTR": "substr", "LENGTH": "length", "TOTAL": "sum", "GROUP_CONCAT": "string_agg", "INSTR": "instr", "RANDOM": "rand"}
DATE_PATTERN = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%j": "DDD"}
# End of fixed values.

_PARTS = re.compile(r"('(?:[^']|'')*')")
_STRFTIME = re.compile(r"(?i)\bSTRFTIME\s*\(\s*('(?:[^']|'')*')\s*,")


def translate(sql: str, casts: bool = True) -> str:
    """IIF, STRFTIME and double-quoted names rewritten; LIKE made blind to case; with ``casts``, CAST made forgiving."""

    def dated(m: re.Match) -> str:
        pattern = m[1]
        for a, b in DATE_PATTERN.items():
            pattern = pattern.replace(a, b)
        return f"\x00{pattern}\x00"

    formats: list[str] = []

    def held(m: re.Match) -> str:
        formats.append(dated(m).strip("\x00"))
        return f"\x01{len(formats) - 1}\x01("

    sql = _STRFTIME.sub(held, sql)
    out = []
    for i, part in enumerate(_PARTS.split(sql)):
        if i % 2 == 0:
            for a, b in FUNCTIONS.items():
                part = re.sub(rf"(?i)\b{a}\s*\(", f"{b}(", part)
            part = re.sub(r"(?i)\bLIKE\b", "ILIKE", part)
            part = re.sub(r"(?i)\bCAST\s*\(", "try_cast(", part) if casts else part
            part = re.sub(r"(?i)\bAS\s+(REAL|NUMERIC)\s*\)", "AS DOUBLE)", part)
            part = re.sub(r"(?i)\bAS\s+TEXT\s*\)", "AS STRING)", part)
            part = re.sub(r"(?i)\bAS\s+INTEGER\s*\)", "AS BIGINT)", part)
            part = re.sub(r'"((?:[^"]|"")*)"', lambda m: "`" + m[1].replace('""', '"').replace("`", "``") + "`", part)
        out.append(part)
    sql = "".join(out)
    # the first argument of STRFTIME is its pattern; date_format takes it last
    while m := re.search(r"\x01(\d+)\x01\(", sql):
        depth, k = 1, m.end()
        while k < len(sql) and depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        sql = f"{sql[: m.start()]}date_format({sql[m.end() : k - 1].strip()}, {formats[int(m[1])]}){sql[k:]}"
    return sql
