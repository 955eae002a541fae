"""Configuration in JSON or a small YAML subset, checked when read."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, fields

from millrace.operators.dedup import DedupOptions
from millrace.operators.rules import RuleError, parse_rules


class ConfigError(ValueError):
    pass


UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}


def duration(x) -> float:
    """Seconds of a number, a bare number as text, or text such as 1h30m; empty is 0."""
    if isinstance(x, (int, float)):
        return float(x)
    text = str(x or "").strip()
    if not text:
        return 0.0
    if re.fullmatch(r"-?\d+(\.\d+)?", text):
        return float(text)
    parts = re.findall(r"(\d+(?:\.\d*)?|\.\d+)(ns|us|µs|ms|s|m|h)", text)
    if "".join(a + b for a, b in parts) != text.lstrip("+-"):
        raise ConfigError(f"bad duration {text}")
    return (-1 if text[0] == "-" else 1) * sum(float(a) * UNITS[b] for a, b in parts)


@dataclass
class SavedSearch:
    name: str = ""
    query: str = ""
    title: str = ""
    limit: int = 0


@dataclass
class Config:
    title: str = "Merged feed"
    link: str = ""
    description: str = ""
    self_link: str = ""
    addr: str = ":8080"
    refresh: float = 900.0
    timeout: float = 20.0
    workers: int = 8
    host_interval: float = 1.0
    max_items: int = 200
    user_agent: str = ""
    title_threshold: float = 0.9
    title_window: float = 259_200.0
    content_threshold: float = 0.0
    filters: list[str] = field(default_factory=list)
    searches: list[SavedSearch] = field(default_factory=list)
    feeds: list[dict] = field(default_factory=list)

    def dedup(self) -> DedupOptions:
        return DedupOptions(self.title_threshold, int(self.title_window), self.content_threshold)


# What a backslash stands for in double quotes.
ESCAPES = {r"\"": '"', r"\\": "\\", r"\n": "\n", r"\t": "\t"}


def _scalar(text: str) -> str:
    """A bare value up to a comment, or what stands between the first and the last quote of a kind."""
    text = text.strip()
    if text[:1] not in ('"', "'") or not text:
        return text.partition(" #")[0].strip()
    end = text.rindex(text[0])
    if not end:
        raise ConfigError(f"unterminated quote: {text}")
    body = text[1:end]
    return re.sub(r'\\["\\nt]', lambda m: ESCAPES[m[0]], body) if text[0] == '"' else body


def parse_yaml(text: str):
    """Maps, sequences and scalars by indentation."""
    lines = []
    for n, raw in enumerate(text.splitlines(), 1):
        if not raw.strip() or raw.strip().startswith("#") or raw.strip() == "---":
            continue
        if "\t" in raw[: len(raw) - len(raw.lstrip())]:
            raise ConfigError(f"line {n}: tab in indentation")
        lines.append((len(raw) - len(raw.lstrip()), raw.strip(), n))

    def block(i: int, depth: int):
        if lines[i][1].startswith("-"):
            out = []
            while i < len(lines) and lines[i][0] == depth and lines[i][1].startswith("-"):
                body, n = lines[i][1][1:].lstrip(), lines[i][2]
                if not body:
                    value, i = block(i + 1, lines[i + 1][0]) if i + 1 < len(lines) and lines[i + 1][0] > depth else ("", i + 1)
                elif re.match(r"[A-Za-z_]\w*:(\s|$)", body):
                    lines[i] = (depth + len(lines[i][1]) - len(body), body, n)
                    value, i = block(i, lines[i][0])
                else:
                    value, i = _scalar(body), i + 1
                out.append(value)
            return out, i
        out = {}
        while i < len(lines) and lines[i][0] == depth:
            m = re.match(r"([A-Za-z_]\w*):(?:\s+(.*))?$", lines[i][1])
            if not m:
                raise ConfigError(f"line {lines[i][2]}: expected key: value")
            key, rest, n = m[1], m[2], lines[i][2]
            if key in out:
                raise ConfigError(f"line {n}: duplicate key {key}")
            deeper = i + 1 < len(lines) and (lines[i + 1][0] > depth or lines[i + 1][0] == depth and lines[i + 1][1].startswith("-"))
            if (rest is None or rest.startswith("#")) and deeper:
                out[key], i = block(i + 1, lines[i + 1][0])
            else:
                out[key], i = _scalar(rest or ""), i + 1
        return out, i

    if not lines:
        return {}
    value, end = block(0, lines[0][0])
    if end != len(lines):
        raise ConfigError(f"line {lines[end][2]}: unexpected indentation")
    return value


def _rows(key: str, value) -> list:
    if value in (None, ""):
        return []
    if not isinstance(value, list):
        raise ConfigError(f"{key} must be a list")
    return value


def _text(key: str, value) -> str:
    if value is not None and not isinstance(value, str):
        raise ConfigError(f"{key} must be text")
    return value or ""


def _record(key: str, value, kinds: dict):
    """A map with known keys only, each read by its kind."""
    if not isinstance(value, dict):
        raise ConfigError(f"each of {key} must be a map")
    if strange := sorted(set(value) - set(kinds)):
        raise ConfigError(f"{key}: unknown key {strange[0]}")
    return {k: kinds[k](f"{key}.{k}", v) for k, v in value.items()}


def _count(key: str, value) -> int:
    try:
        if isinstance(value, bool) or isinstance(value, float) and value != int(value):
            raise ValueError("not a whole number")
        return int(value or 0)
    except (TypeError, ValueError) as e:
        raise ConfigError(f"{key}: {e}") from e


def _number(key: str, value) -> float:
    try:
        if isinstance(value, bool):
            raise ValueError("not a number")
        return float(value)
    except (TypeError, ValueError) as e:
        raise ConfigError(f"{key}: {e}") from e


def _seconds(key: str, value) -> float:
    try:
        if isinstance(value, bool) or not isinstance(value, (int, float, str)):
            raise ValueError("not a duration")
        return duration(value)
    except (TypeError, ValueError) as e:
        raise ConfigError(f"{key}: {e}") from e


def _search(key: str, value) -> SavedSearch:
    return SavedSearch(**_record(key, value, {"name": _text, "query": _text, "title": _text, "limit": _count}))


def _feed(key: str, value) -> dict:
    own = {"url": value} if isinstance(value, str) else _record(key, value, {"url": _text, "name": _text})
    return {"url": own.get("url", "").strip(), "name": own.get("name", "")}


DURATIONS = ("refresh", "timeout", "host_interval", "title_window")
LISTS = {"filters": _text, "searches": _search, "feeds": _feed}


def load(text: str, yaml: bool | None = None) -> Config:
    """The checked configuration of a YAML or JSON text; every fault in it is a ConfigError."""
    try:
        raw = parse_yaml(text) if yaml or (yaml is None and not text.lstrip().startswith("{")) else json.loads(text)
    except json.JSONDecodeError as e:
        raise ConfigError(f"no JSON: {e}") from e
    if not isinstance(raw, dict):
        raise ConfigError("the configuration must be a map of keys")
    known = {f.name for f in fields(Config)}
    out = Config()
    for key, v in raw.items():
        if key not in known:
            raise ConfigError(f"unknown key {key}")
        old = getattr(out, key)
        if key in LISTS:
            v = [LISTS[key](key, x) for x in _rows(key, v)]
        elif isinstance(old, str):
            v = _text(key, v)
        elif v in ("", None):
            # An empty number keeps its default.
            continue
        else:
            v = _seconds(key, v) if key in DURATIONS else _count(key, v) if isinstance(old, int) else _number(key, v)
        setattr(out, key, v)
    return checked(out)


def read(path: str) -> Config:
    """The configuration in a file, JSON by its ending or its first brace."""
    with open(path, encoding="utf-8") as f:
        return load(f.read(), False if path.endswith(".json") else None)


def checked(c: Config) -> Config:
    c.workers, c.max_items, c.timeout = max(1, c.workers), max(0, c.max_items), c.timeout or 20.0
    urls = [f["url"] for f in c.feeds]
    problems = {
        "at least one feed is needed": not urls,
        "feeds must be http or https": any(not u.startswith(("http://", "https://")) for u in urls),
        "feed urls must be unique": len(set(urls)) < len(urls),
        "thresholds must be within 0 and 1": not all(0 <= x <= 1 for x in (c.title_threshold, c.content_threshold)),
        "durations must not be negative": min(c.refresh, c.timeout, c.host_interval) < 0,
        "a saved search needs a name of letters, digits, _ and -": any(not re.fullmatch(r"[A-Za-z0-9_-]+", s.name) for s in c.searches),
        "saved searches must be unique": len({s.name for s in c.searches}) < len(c.searches),
        "a saved search needs a query": any(not s.query.strip() for s in c.searches),
        "limits must not be negative": any(s.limit < 0 for s in c.searches),
    }
    for text, bad in problems.items():
        if bad:
            raise ConfigError(text)
    try:
        parse_rules(c.filters)
    except RuleError as e:
        raise ConfigError(f"filters: {e}") from e
    return c
