"""The filter language: lines of ``include|exclude field operator pattern`` compiled to one Column."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("title", "content", "summary", "link", "author", "category", "source", "any")
OPERATORS = ("~", "=~", "!~")
LINE = re.compile(r"(\S+)\s+(\S+)\s+(\S+)\s+(.*)", re.S)


class RuleError(ValueError):
    pass


@dataclass(frozen=True)
class Rule:
    exclude: bool
    field: str
    negated: bool
    pattern: str


def java_regex(pattern: str, flags: str = "") -> str:
    """The same search in Java's dialect; constructs that linear-time engines lack are errors."""
    out, at, in_class = [], 0, False
    while at < len(pattern):
        two, c = pattern[at : at + 2], pattern[at]
        if c == "\\":
            if len(two) < 2:
                raise RuleError("trailing backslash")
            if not in_class and (two[1].isdigit() and two[1] != "0" or two[1] == "k"):
                raise RuleError("backreferences are not supported")
            word = r"[0-9A-Za-z_]"
            edge = rf"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))"
            out.append({r"\b": edge, r"\B": rf"(?!{edge})", r"\z": r"\z", r"\C": "."}.get(two, two) if not in_class else two)
            at += 2
            continue
        if in_class:
            if pattern.startswith("[:", at) and (end := pattern.find(":]", at)) > 0:
                name = pattern[at + 2 : end]
                out.append(("\\P{" if name.startswith("^") else "\\p{") + {"word": "Alnum}_"}.get(name.strip("^"), name.strip("^").capitalize() + "}").replace("Xdigit", "XDigit").replace("Ascii", "ASCII"))
                at = end + 2
                continue
            in_class = c != "]" or pattern[at - 1 : at] == "["
            out.append("\\[" if c == "[" else "\\&" if c == "&" else c)
        elif c == "[":
            in_class = True
            out.append(c)
            if pattern[at + 1 : at + 2] == "^":
                out.append("^")
                at += 1
        elif pattern.startswith("(?P<", at):
            out.append("(?<")
            at += 3
        elif re.match(r"\(\?(?:[=!>]|<[=!])", pattern[at:]):
            raise RuleError("lookaround is not supported")
        elif c in "*+?}" and pattern[at + 1 : at + 2] == "+":
            raise RuleError("possessive repetition is not supported")
        elif c == "$":
            out.append(r"\z")
        else:
            out.append(c)
        at += 1
    if in_class:
        raise RuleError("missing ]")
    java = f"(?d{'iu' if 'i' in flags else ''}{'s' if 's' in flags else ''})" + "".join(out)
    try:
        re.compile(re.sub(r"\\z", "$", pattern.replace("(?i)", "").replace("(?s)", "").replace("[[:", "[").replace(":]]", "]")) if "\\p" not in pattern and "\\P" not in pattern else "")
    except re.error as e:
        raise RuleError(f"bad pattern: {e}") from e
    return java


def unwrapped(text: str) -> tuple[str, str]:
    """A bare pattern, or /pattern/flags split at its last slash."""
    text = text.strip()
    if not text:
        raise RuleError("empty pattern")
    if not text.startswith("/"):
        return text, ""
    body, slash, flags = text[1:].rpartition("/")
    if not slash:
        raise RuleError("unterminated pattern")
    if not body:
        raise RuleError("empty pattern")
    if bad := set(flags) - set("is"):
        raise RuleError(f"unknown flag {sorted(bad)[0]}")
    return body, flags


def parse_rule(line: str) -> Rule:
    m = LINE.fullmatch(line.strip())
    if not m:
        raise RuleError("a rule is: include|exclude field operator pattern")
    action, field, operator, pattern = m[1].lower(), m[2].lower(), m[3], m[4]
    if action not in ("include", "exclude"):
        raise RuleError(f"unknown action {m[1]}")
    if field not in FIELDS:
        raise RuleError(f"unknown field {m[2]}")
    if operator not in OPERATORS:
        raise RuleError(f"unknown operator {operator}")
    return Rule(action == "exclude", field, operator == "!~", java_regex(*unwrapped(pattern)))


def parse_rules(text: str | list[str]) -> list[Rule]:
    """All rules; blank lines and # comments are skipped, errors carry the line number."""
    out = []
    for n, line in enumerate(text.splitlines() if isinstance(text, str) else text, 1):
        if line.strip() and not line.strip().startswith("#"):
            try:
                out.append(parse_rule(line))
            except RuleError as e:
                raise RuleError(f"line {n}: {e}") from None
    return out


def field_text(name: str) -> Column:
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    category = F.coalesce(F.array_join("categories", " "), F.lit(""))
    if name == "category":
        return category
    if name == "source":
        return F.concat_ws(" ", empty("source_title"), empty("source_url"))
    if name == "any":
        return F.concat_ws("\n", *map(empty, ("title", "summary", "content", "link", "author")), category, empty("source_title"))
    return empty(name)


def allowed(rules: list[Rule]) -> Column:
    """Kept: no exclude rule matches, and some include rule does if there are any."""
    hit = lambda r: ~field_text(r.field).rlike(r.pattern) if r.negated else field_text(r.field).rlike(r.pattern)
    keep, included = F.lit(True), [hit(r) for r in rules if not r.exclude]
    for r in rules:
        if r.exclude:
            keep = keep & ~hit(r)
    if included:
        some = included[0]
        for c in included[1:]:
            some = some | c
        keep = keep & some
    return keep


def filtered(entries: DataFrame, rules: str | list[Rule]) -> DataFrame:
    return entries.where(allowed(parse_rules(rules) if isinstance(rules, str) else rules))
