"""Semantic elements of requirement statements.

One Arrow kernel reads the texts of a batch and gives each its claims (spans of elements), the tiles that cover it and
the kind of its function. As native columns the same stages nest so deep that the optimizer copies them many times and
the generated code is too large to be compiled; here each text is read once, and only the text goes to Python. The
kernel counts as non-deterministic, so no filter is moved below it and it never runs twice.

Offsets are 0-based code points, ends exclusive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqloom.functions.grammar import RUPP, Grammar
from reqloom.functions.vocab import OBLIGATION, ROLES, TERMINAL_ROLES

CLAIM = "struct<start:int,end:int,role:string,marker:string,kind:string>"
#: start, end, role, marker, kind
Claim = tuple[int, int, str, "str | None", "str | None"]


class _Reader:
    """One text, read from left to right; ``claims`` grows in the order of discovery."""

    def __init__(self, text: str, g: Grammar):
        self.text, self.g, self.claims = text, g, []

    def claim(self, start: int, end: int, role: str, marker: str | None = None, kind: str | None = None) -> None:
        """Claim a span without the white space around it; an empty one is none."""
        body = self.text[start:end]
        start += len(body) - len(body.lstrip())
        body = body.strip()
        if body:
            self.claims.append((start, start + len(body), role, marker, kind))

    def opening(self) -> tuple[int, int]:
        """Leading condition; gives where the subject begins and where the search for a modal starts."""
        m = self.g.patterns["lead"].match(self.text)
        if not m:
            return 0, 0
        comma = self.text.find(",", m.end())
        search = comma + 1 if comma >= 0 else m.end()
        found = self.g.patterns["modal"].search(self.text[search:])
        until = search + found.start() if found else len(self.text)
        stop = self.text.rfind(",", m.end(), until)
        if stop < 0:
            then = self.g.patterns["then"].search(self.text[m.end() : until])
            if not then:
                return 0, search
            stop = m.end() + then.start()
        self.claim(m.start(1), stop, "CONDITION", m.group(1).lower(), "pre-condition")
        begin = stop + (self.text[stop] == ",")
        then = self.g.patterns["skip_then"].match(self.text[begin:])
        return begin + (then.end() if then else 0), search

    def ending(self, window: str, at: int, cue: str, role: str, kind: str | None) -> str:
        """Cut what a cue opens off the end of the window at ``at``; nothing may be cut off whole."""
        m = self.g.patterns[cue].search(window)
        if not m or not m.start():
            return window
        self.claim(at + m.start(), at + len(window), role, m.group().lower(), kind)
        return window[: m.start()]

    def action(self, start: int, end: int, kind: str) -> None:
        """A process and, from the first noun marker on, its object."""
        body = self.text[start:end]
        start += len(body) - len(body.lstrip())
        body = body.strip()
        noun = self.g.patterns["noun"].search(body)
        cut = noun.start() if noun and noun.start() else len(body)
        self.claim(start, start + cut, "PROCESS", None, kind)
        self.claim(start + cut, start + len(body), "OBJECT")

    def read(self) -> str:
        """Fill ``claims``; gives the kind of function."""
        p = self.g.patterns
        begin, search = self.opening()
        modal = p["modal"].search(self.text[search:])
        at = begin
        if modal:
            self.claim(search + modal.start(), search + modal.end(), "MODALITY", None, OBLIGATION.get(modal.group().lower(), "unspecified"))
            self.claim(begin, search + modal.start(), "SUBJECT")
            at = search + modal.end()
        window = self.text[at:].rstrip(".;\n\t ")
        window = self.ending(window, at, "condition", "CONDITION", "post-condition")
        window = self.ending(window, at, "limit", "CONSTRAINT", None)
        actor, able = p["actor"].search(window), p["interface"].search(window)
        if actor:
            kind, core = "user interaction", actor.end()
            self.claim(at + actor.start(1), at + actor.end(1), "ACTOR")
        elif able:
            kind, core = "interface requirement", able.end()
        else:
            kind, core = "autonomous activity", 0
        body = window[core:]
        core += len(body) - len(body.lstrip())
        second = p["next_action"].search(body.strip())
        end = at + len(window)
        if second:
            self.action(at + core, at + core + second.start(), kind)
            self.action(at + core + second.end(), end, kind)
        else:
            self.action(at + core, end, kind)
        return kind


def cover(claims: Iterable[Claim], length: int) -> list[Claim]:
    """Tiles of a text: its claims (of overlapping ones the first, of those the longest), and GLUE between them."""
    out, upto = [], 0
    for c in sorted(claims, key=lambda c: (c[0], -c[1])):
        if c[0] >= upto:
            if c[0] > upto:
                out.append((upto, c[0], "GLUE", None, None))
            out.append(c)
            upto = c[1]
    if upto < length:
        out.append((upto, length, "GLUE", None, None))
    return out


_STRUCT = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("role", pa.string()), ("marker", pa.string()), ("kind", pa.string())])


def _lists(rows: list[list[Claim] | None]) -> pa.Array:
    """Rows of claims as one list array; None stays null."""
    flat = [c for r in rows if r for c in r]
    cols = list(zip(*flat, strict=True)) if flat else [()] * 5
    values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _STRUCT, strict=True)], fields=list(_STRUCT))
    offsets, n = [0], 0
    for r in rows:
        n += len(r or ())
        offsets.append(n)
    starts = pa.array([None if r is None else o for r, o in zip(rows, offsets[:-1], strict=True)] + [n], pa.int32())
    return pa.ListArray.from_arrays(starts, values)


def extract(df: DataFrame, g: Grammar = RUPP, text: str = "text") -> DataFrame:
    """``df`` with ``claims`` (array of start, end, role, marker, kind in order of extraction), ``tiles`` and
    ``function_type``.

    A null text gives nulls, an empty one no claim and no tile. ``marker`` is the lower-cased marker of conditions and
    constraints, ``kind`` a condition's place, a modality's obligation or a process's function type.
    """

    @F.arrow_udf(f"struct<claims:array<{CLAIM}>,tiles:array<{CLAIM}>,function_type:string>")
    def kernel(texts: pa.Array) -> pa.Array:
        claims, tiles, kinds = [], [], []
        for t in texts.to_pylist():
            if t is None:
                for out in (claims, tiles, kinds):
                    out.append(None)
                continue
            r = _Reader(t, g)
            kinds.append(r.read())
            claims.append(r.claims)
            tiles.append(cover(r.claims, len(t)))
        return pa.StructArray.from_arrays([_lists(claims), _lists(tiles), pa.array(kinds, pa.string())], names=["claims", "tiles", "function_type"])

    rest = [c for c in df.columns if c not in ("claims", "tiles", "function_type")]
    got = df.select(*rest, kernel.asNondeterministic()(F.col(text)).alias("_found"))
    return got.select(*rest, "_found.claims", "_found.tiles", "_found.function_type")


def extract_with(df: DataFrame, find: Callable[[str], Iterable[dict]], text: str = "text", roles: tuple[str, ...] = ROLES) -> DataFrame:
    """``df`` with ``claims``, ``tiles`` and ``error`` from an extractor of one's own.

    ``find`` takes a text and gives dicts with start, end, role and perhaps marker and kind. Claims are clamped to the
    text, empty, malformed and unknown ones dropped. Where it raises, ``error`` holds the message, claims are empty and
    the whole text is one GLUE tile; else ``error`` is ''. A null text gives nulls and no error.
    """

    def claims_of(t: str) -> list[Claim]:
        out = []
        for c in find(t):
            a, b, role = c.get("start"), c.get("end"), c.get("role")
            if isinstance(a, int) and isinstance(b, int) and role in roles:
                a, b = min(max(a, 0), len(t)), min(max(b, 0), len(t))
                if b > a:
                    out.append((a, b, role, c.get("marker"), c.get("kind")))
        return out

    @F.arrow_udf(f"struct<claims:array<{CLAIM}>,tiles:array<{CLAIM}>,error:string>")
    def kernel(texts: pa.Array) -> pa.Array:
        claims, tiles, errors = [], [], []
        for t in texts.to_pylist():
            error, got = "", None
            if t is not None:
                try:
                    got = claims_of(t)
                except Exception as e:  # noqa: BLE001 - an extractor's failure is a value of the row
                    error, got = f"{type(e).__name__}: {e}", []
            claims.append(got)
            tiles.append(None if t is None else cover(got, len(t)))
            errors.append(error)
        return pa.StructArray.from_arrays([_lists(claims), _lists(tiles), pa.array(errors, pa.string())], names=["claims", "tiles", "error"])

    rest = [c for c in df.columns if c not in ("claims", "tiles", "error")]
    got = df.select(*rest, kernel.asNondeterministic()(F.col(text)).alias("_found"))
    return got.select(*rest, "_found.claims", "_found.tiles", "_found.error")


def sanitise(claims: Column, length: Column, roles: tuple[str, ...] = TERMINAL_ROLES) -> Column:
    """Claims clamped to the text; empty ones and unknown roles are dropped. Claims are arrays of CLAIM structs."""

    def clamp(x: Column) -> Column:
        lo = F.least(F.greatest(x["start"], F.lit(0)), length)
        hi = F.least(F.greatest(x["end"], F.lit(0)), length)
        return F.struct(lo.alias("start"), hi.alias("end"), x["role"].alias("role"), x["marker"].alias("marker"), x["kind"].alias("kind"))

    return F.filter(F.transform(F.filter(claims, lambda x: x.isNotNull() & x["start"].isNotNull() & x["end"].isNotNull()), clamp), lambda x: (x["end"] > x["start"]) & x["role"].isin(*roles))


def resolve_overlaps(claims: Column) -> Column:
    """Claims in text order, of overlapping ones the first, and the longest of those that start together."""
    order = F.array_sort(
        claims,
        lambda x, y: F.when(x["start"] != y["start"], x["start"] - y["start"]).otherwise((y["end"] - y["start"]) - (x["end"] - x["start"])).cast("int"),
    )
    zero = F.struct(F.lit(-1).alias("upto"), F.array().cast(f"array<{CLAIM}>").alias("kept"))
    step = lambda acc, x: F.when(x["start"] >= acc["upto"], F.struct(x["end"].alias("upto"), F.array_append(acc["kept"], x).alias("kept"))).otherwise(acc)
    return F.aggregate(order, zero, step, lambda acc: acc["kept"])
