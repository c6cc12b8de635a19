"""Whole rule packs over files: one automaton for all literals of all rules, with offsets and surroundings.

A pack's literals, folded to lower case, form one Aho-Corasick automaton that reads a file
once, whatever their number; a hit's case and word bounds are then tested where its string
asks for it. Patterns are tried at every offset. A file is its UTF-8 bytes, as are offsets and
lengths. Conditions stay Spark columns, over the counts that the automaton gives.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurescope.operators.rules import Rule, RuleError, compile_rule, parse_rules

MATCH = "rule string, string string, offset int, length int, matched string, before string, after string"


def load_rules(paths: list[str]) -> tuple[list[Rule], list[dict]]:
    """All rules of the files (those of a folder: ``.yar`` and ``.yara``, in order), and the errors of files that were left out.

    A file with an error is left out as a whole and the others are used; of two rules of
    one name, the first stays.
    """
    files = [f for p in paths for f in (sorted(q for q in Path(p).rglob("*") if q.suffix in (".yar", ".yara")) if Path(p).is_dir() else [Path(p)])]
    rules, errors, names = [], [], set()
    for f in files:
        source = f.read_text(encoding="utf-8", errors="replace")
        wrong = check_rules(source)
        if wrong:
            errors += [{"file": f.name, **e} for e in wrong]
            continue
        for r in parse_rules(source):
            if r.name not in names:
                names.add(r.name)
                rules.append(r)
    return rules, errors


def check_rules(source: str) -> list[dict]:
    """What is wrong with a source, as line (null where unknown) and message; nothing if it compiles."""
    if not source.strip():
        return [{"line": None, "message": "empty source"}]
    try:
        for r in parse_rules(source):
            for kind, value, fold in r.strings.values():
                if kind == "regex":
                    re.compile(value.encode(), re.I if fold else 0)
            compile_rule(r, found=lambda s: F.lit(True), number=lambda s: F.lit(1))
    except (RuleError, re.error) as e:
        name = str(e).split(":")[0]
        at = re.search(rf"\brule\s+{re.escape(name)}\b", source) or re.search(r'^\s*include\s+"', source, re.M)
        return [{"line": source.count("\n", 0, at.start()) + 1 if at else None, "message": str(e)}]
    return []


class Pack:
    """The strings of rules, numbered in order, and what finds them."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules
        self.strings = [(r.name, s, *r.strings[s], s in r.whole) for r in rules for s in r.strings]
        self.number = {(r, s): i for i, (r, s, *_) in enumerate(self.strings)}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_engine"}

    def engine(self):
        if "_engine" not in self.__dict__:
            named: dict[bytes, list[tuple[int, bytes | None, bool]]] = {}
            patterns = []
            for i, (_, _, kind, value, fold, whole) in enumerate(self.strings):
                raw = value.encode()
                if kind == "regex":
                    patterns.append((i, re.compile(raw, re.I if fold else 0), whole))
                elif raw:
                    named.setdefault(raw.lower(), []).append((i, None if fold else raw, whole))
            automaton = ahocorasick.Automaton()
            for low, uses in named.items():
                automaton.add_word(low.decode("latin-1"), (len(low), uses))
            if named:
                automaton.make_automaton()
            self._engine = automaton if named else None, patterns
        return self._engine

    def find(self, data: bytes) -> Iterator[tuple[int, int, int]]:
        """(string, offset, length) of all matches, literals first in order of their ends."""
        automaton, patterns = self.engine()
        if automaton is not None:
            for end, (n, uses) in automaton.iter(data.lower().decode("latin-1")):
                at = end + 1 - n
                for i, exact, whole in uses:
                    if (exact is None or data.startswith(exact, at)) and (not whole or alone(data, at, end + 1)):
                        yield i, at, n
        for i, pattern, whole in patterns:
            m = pattern.search(data)
            while m:
                if m.end() > m.start() and (not whole or alone(data, m.start(), m.end())):
                    yield i, m.start(), m.end() - m.start()
                m = pattern.search(data, m.start() + 1)


def alone(data: bytes, start: int, end: int) -> bool:
    """Whether no ASCII letter or digit touches a match."""
    beside = data[max(start - 1, 0) : start] + data[end : end + 1]
    return not any(chr(b).isalnum() for b in beside if b < 128)


def scan_pack(files: DataFrame, content: str, rules: list[Rule]) -> DataFrame:
    """``files`` with the names of the rules that match in ``rules``, in order. A null content counts as empty, on which rules of absence match."""
    pack = Pack(rules)
    sent = files.sparkSession.sparkContext.broadcast(pack)

    @F.arrow_udf("array<int>")
    def count(text: pa.Array) -> pa.Array:
        held, out = sent.value, []
        for t in text.to_pylist():
            n = [0] * len(held.strings)
            for i, _, _ in held.find((t or "").encode()):
                n[i] += 1
            out.append(n)
        return pa.array(out, pa.list_(pa.int32()))

    def verdict(rule: Rule) -> Column:
        number = lambda s: F.get("_counts", F.lit(pack.number[rule.name, s]))
        return F.when(compile_rule(rule, found=lambda s: number(s) > 0, number=number), F.lit(rule.name))

    hits = F.array_compact(F.array(*map(verdict, rules))) if rules else F.array().cast("array<string>")
    return files.withColumn("_counts", count(F.col(content).cast("string"))).withColumn("rules", hits).drop("_counts")


def string_matches(files: DataFrame, id_col: str, content: str, rules: list[Rule], around: int = 64, flush: int = 10_000) -> DataFrame:
    """A row for each match of a string: id, rule, string, offset, length, matched, before, after.

    ``before`` and ``after`` hold up to ``around`` bytes; bytes that are no UTF-8 by
    themselves are replaced. Matches of one string may overlap. No match is left out.
    """
    sent = files.sparkSession.sparkContext.broadcast(Pack(rules))
    slim = files.select(F.col(id_col).alias("id"), F.col(content).cast("string").alias("text")).filter("text is not null")
    names = ["id", *[c.strip().split()[0] for c in MATCH.split(",")]]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_pack = sent.value
        for batch in batches:
            types = [batch.schema.field("id").type, pa.string(), pa.string(), pa.int32(), pa.int32(), *[pa.string()] * 3]
            rows: list[tuple] = []

            def out() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

            for key, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist()):
                data = text.encode()
                for i, at, n in held_pack.find(data):
                    shown = [data[at : at + n], data[max(at - around, 0) : at], data[at + n : at + n + around]]
                    rows.append((key, *held_pack.strings[i][:2], at, n, *[b.decode("utf-8", "replace") for b in shown]))
                    if len(rows) >= flush:
                        yield out()
                        rows = []
            if rows:
                yield out()

    return slim.mapInArrow(read, f"id {dict(slim.dtypes)['id']}, {MATCH}")
