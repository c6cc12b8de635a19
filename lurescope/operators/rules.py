"""Detection rules of the bundled grammar, compiled to boolean columns."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class RuleError(ValueError):
    """A rule that the grammar does not have."""


@dataclass
class Rule:
    name: str
    strings: dict[str, tuple[str, str, bool]] = field(default_factory=dict)  # id: text or regex, value, any case
    condition: str = ""
    meta: dict[str, str] = field(default_factory=dict)
    whole: set[str] = field(default_factory=set)  # strings that stand alone, without a letter or digit beside


_HEAD = re.compile(r"(?:private\s+|global\s+)*rule\s+(\w+)\s*(?::[\w\s]+)?\{")
_STRING = re.compile(r'(\$\w*)\s*=\s*(?:"((?:[^"\\]|\\.)*)"|/((?:[^/\\]|\\.)+)/([is]*))((?:\s+(?:nocase|ascii|fullword))*)')
_META = re.compile(r'(\w+)\s*=\s*(?:"((?:[^"\\]|\\.)*)"|(\w+))')
_TOKEN = re.compile(r"\s*(\$\w*\*?|#\w+|\d+|>=|<=|==|>|<|[(),]|\w+)")


_QUOTED = r'"(?:[^"\\\n]|\\.)*"|(?<==)\s*/(?![/*])(?:[^/\\\n]|\\.)+/'


def _outside(text: str) -> str:
    """Without comments; strings and patterns stay."""
    return re.sub(rf"({_QUOTED})|//[^\n]*|/\*.*?\*/", lambda m: m[1] or " ", text, flags=re.S)


def parse_rules(source: str) -> list[Rule]:
    if re.search(r'^\s*include\s+"', source, re.M):
        raise RuleError("include is not allowed")
    text, rules, at = _outside(source), [], 0
    # Braces and section names inside strings and patterns are none.
    shape = re.sub(_QUOTED, lambda m: "_" * len(m[0]), text)
    while m := _HEAD.search(shape, at):
        depth, i = 1, m.end()
        while i < len(shape) and depth:
            depth += (shape[i] == "{") - (shape[i] == "}")
            i += 1
        if depth:
            raise RuleError(f"{m[1]}: no closing brace")
        sections, at = list(re.compile(r"\b(meta|strings|condition)\s*:").finditer(shape, m.end(), i - 1)), i
        ends = [*[x.start() for x in sections[1:]], i - 1]
        got = {x[1]: text[x.end() : end] for x, end in zip(sections, ends)}
        if "condition" not in got:
            raise RuleError(f"{m[1]}: no condition")
        rule = Rule(m[1], condition=got["condition"].strip(), meta={k[1]: k[2] if k[2] is not None else k[3] for k in _META.finditer(got.get("meta", ""))})
        for s in _STRING.finditer(got.get("strings", "")):
            if s[2] is not None:
                rule.strings[s[1]] = ("text", re.sub(r"\\(?:x([0-9a-fA-F]{2})|(.))", lambda e: chr(int(e[1], 16)) if e[1] else {"n": "\n", "t": "\t", "r": "\r"}.get(e[2], e[2]), s[2]), "nocase" in s[5])
            else:
                rule.strings[s[1]] = ("regex", s[3].replace("\\/", "/"), "i" in s[4] or "nocase" in s[5])
            if "fullword" in s[5]:
                rule.whole.add(s[1])
        rules.append(rule)
    if not rules and text.strip():
        raise RuleError("no rule found")
    return rules


def _found(content: Column, string: tuple[str, str, bool], whole: bool = False) -> Column:
    kind, value, fold = string
    if whole:
        pattern = value if kind == "regex" else re.escape(value)
        return content.rlike(("(?i)" if fold else "") + f"(?<![0-9A-Za-z])(?:{pattern})(?![0-9A-Za-z])")
    if kind == "regex":
        return content.rlike(("(?i)" if fold else "") + value)
    return F.lower(content).contains(value.lower()) if fold else content.contains(value)


def _number(content: Column, string: tuple[str, str, bool]) -> Column:
    kind, value, fold = string
    pattern = value if kind == "regex" else re.escape(value)
    return F.regexp_count(content, F.lit(("(?i)" if fold else "") + pattern))


def compile_rule(rule: Rule, content: Column | None = None, found=None, number=None) -> Column:
    """The rule's condition as a boolean column, over a file's content or over what ``found`` and ``number`` give for its strings."""
    found = found or (lambda s: _found(content, rule.strings[s], s in rule.whole))
    number = number or (lambda s: _number(content, rule.strings[s]))
    tokens = [m[1] for m in _TOKEN.finditer(rule.condition)]
    at = 0

    def peek() -> str | None:
        return tokens[at] if at < len(tokens) else None

    def take(want: str | None = None) -> str:
        nonlocal at
        if at >= len(tokens) or want is not None and tokens[at] != want:
            raise RuleError(f"{rule.name}: {want or 'more'} expected in condition")
        at += 1
        return tokens[at - 1]

    def named(pattern: str) -> list[str]:
        got = [s for s in rule.strings if s == pattern or pattern.endswith("*") and s.startswith(pattern[:-1])]
        if not got:
            raise RuleError(f"{rule.name}: no string {pattern}")
        return got

    def of_set() -> list[str]:
        if peek() == "them":
            take()
            return list(rule.strings)
        take("(")
        out = named(take())
        while peek() == ",":
            take()
            out += named(take())
        take(")")
        return out

    def atom() -> Column:
        t = take()
        if t == "(":
            inner = either()
            take(")")
            return inner
        if t == "not":
            return ~atom()
        if t in ("true", "false"):
            return F.lit(t == "true")
        if t in ("any", "all") or t.isdigit():
            take("of")
            hits = [found(s) for s in of_set()]
            if t == "any":
                return reduce(lambda a, b: a | b, hits)
            if t == "all":
                return reduce(lambda a, b: a & b, hits)
            return reduce(lambda a, b: a + b, (h.cast("int") for h in hits)) >= int(t)
        if t.startswith("#"):
            op, n = take(), int(take())
            count = number(named("$" + t[1:])[0])
            return {">": count > n, "<": count < n, ">=": count >= n, "<=": count <= n, "==": count == n}[op]
        if t.startswith("$"):
            return found(named(t)[0])
        raise RuleError(f"{rule.name}: {t} in condition")

    def each() -> Column:
        out = atom()
        while peek() == "and":
            take()
            out = out & atom()
        return out

    def either() -> Column:
        out = each()
        while peek() == "or":
            take()
            out = out | each()
        return out

    out = either()
    if at != len(tokens):
        raise RuleError(f"{rule.name}: {tokens[at]} is left over in condition")
    return F.coalesce(out, F.lit(False))


def scan(files: DataFrame, content: str, rules: list[Rule]) -> DataFrame:
    """``files`` with the names of the rules that match, in order."""
    hits = F.array(*(F.when(compile_rule(r, F.col(content)), r.name) for r in rules)) if rules else F.array().cast("array<string>")
    return files.withColumn("rules", F.array_compact(hits))
