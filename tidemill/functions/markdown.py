"""Markdown from PDF snippets: tables whose rows were flattened into one line, or that lost their header, made whole."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

FENCE = re.compile(r"^\s{0,3}(`{3,}|~{3,})")
BREAK = re.compile(r"<br\s*/?\s*>", re.I)
BAR, GLUED = re.compile(r"(?<!\\)\|"), re.compile(r"(?<!\\)\|[ \t]+(?=\|)")
RULE = re.compile(r"\s*:?-{3,}:?\s*")


def cells(row: str) -> list[str]:
    row = row.strip().removeprefix("|")
    return BAR.split(row[:-1] if row.endswith("|") and not row.endswith("\\|") else row)


def is_rule(row: str) -> bool:
    """Whether a row is the line of dashes under a header."""
    parts = cells(row)
    return len(parts) >= 2 and all(RULE.fullmatch(p) for p in parts)


def _headless(rows: list[str], least: int = 2) -> list[str]:
    """A table with empty headings over rows that have none: nothing is guessed and no cell is lost."""
    parts = [cells(r) for r in rows]
    width = max([least, *map(len, parts)])
    return ["|" + " |" * width, "|" + " --- |" * width, *("|" + "|".join(p) + "|" * (width - len(p) + 1) for p in parts)]


def _rows(text: str):
    """(line, literal) of a text: code is literal, flattened tables are cut into their rows."""
    fence = ""
    for line in text.split("\n"):
        mark = FENCE.match(line)
        if mark:
            if not fence:
                fence = mark[1]
            elif mark[1][0] == fence[0] and len(mark[1]) >= len(fence):
                fence = ""
        if mark or fence or "`" in line or line.startswith(("    ", "\t")):
            yield line, True
            continue
        line = BREAK.sub(" ", line)
        parts = GLUED.split(line)
        parts = [p + "|" for p in parts[:-1]] + parts[-1:]
        yield from ((p, False) for p in (parts if len(parts) > 1 and any(map(is_rule, parts)) else [line]))


def repaired(text: str) -> str:
    rows, out = list(_rows(text)), []
    ruled = [not literal and is_rule(line) for line, literal in rows]

    def apart() -> None:
        if out and out[-1].strip():
            out.append("")

    def loose(line: str) -> bool:
        return line.rstrip().endswith("|") and len(cells(line)) >= 2 and not is_rule(line)

    at = 0
    while at < len(rows):
        line, _ = rows[at]
        at += 1
        if not ruled[at - 1]:
            out.append(line)
            continue
        width = len(cells(line))
        if at > 1 and not rows[at - 2][1] and not ruled[at - 2] and len(cells(rows[at - 2][0])) == width:
            header, stray = out.pop(), []
            while out and loose(out[-1]):
                stray.append(out.pop())
            stray.reverse()
            out += stray if not stray or any(map(is_rule, out)) else [*_headless(stray), ""]
            apart()
            out += [header, line]
            continue
        end = at
        while end < len(rows) and not rows[end][1] and rows[end][0].lstrip().startswith("|") and not ruled[end] and not (end + 1 < len(rows) and ruled[end + 1]):
            end += 1
        apart()
        out += [*_headless([r for r, _ in rows[at:end]], width), ""]
        at = end
    return "\n".join(out)


@F.pandas_udf(StringType())
def repaired_tables(texts: pd.Series) -> pd.Series:
    """Each text with its tables made whole; null stays null."""
    return texts.map(lambda x: None if x is None else repaired(x))
