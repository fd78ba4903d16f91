"""Grammars: which markers open which part of a statement, and in which order a statement is written."""

from __future__ import annotations

import re
from functools import cached_property

from reqloom.functions import vocab


class Grammar:
    """Markers by cue. ``Grammar(other, limit=(...))`` is ``other`` with some cues changed.

    Cues: condition, modal, limit (opens a constraint), noun (opens an object), joint (joins actions), offer and bridge
    (around an actor), interface. A cue without markers is never found. ``order``: roles in writing order.
    """

    CUES = ("condition", "modal", "limit", "noun", "joint", "offer", "bridge", "interface")

    def __init__(self, like: Grammar | None = None, order: tuple[str, ...] | None = None, **cues: tuple[str, ...]):
        if unknown := set(cues) - set(self.CUES):
            raise ValueError(f"unknown cues: {sorted(unknown)}")
        base = like.cues if like else dict.fromkeys(self.CUES, ())
        self.cues: dict[str, tuple[str, ...]] = base | {k: tuple(v) for k, v in cues.items()}
        self.order = order or (like.order if like else vocab.ROLES)

    def any_of(self, cue: str) -> str:
        """Alternation of a cue's markers, longest first; never matches without any."""
        return "|".join(re.escape(m) for m in sorted(self.cues[cue], key=len, reverse=True)) or "(?!)"

    @cached_property
    def patterns(self) -> dict[str, re.Pattern]:
        """Compiled patterns of the cues as whole words, and of what statements need besides."""
        word = {c: rf"(?<![\w'])(?:{self.any_of(c)})(?![\w'])" for c in self.CUES}
        return {c: re.compile(p, re.I) for c, p in word.items()} | {
            "lead": re.compile(rf"\s*({self.any_of('condition')})(?![\w'])", re.I),
            "then": re.compile(r"(?<![\w'])then(?![\w'])", re.I),
            "skip_then": re.compile(r"\s*then(?![\w'])", re.I),
            "actor": re.compile(rf"(?<![\w'])(?:{self.any_of('offer')})\s+(.+?)\s+(?:{self.any_of('bridge')})(?![\w'])", re.I),
            "next_action": re.compile(rf"\s+(?:{self.any_of('joint')})\s+(?!(?:{self.any_of('noun')})(?![\w']))(?=[\w'])", re.I),
        }

    def __getstate__(self) -> dict:
        return {"cues": self.cues, "order": self.order}


RUPP = Grammar(
    condition=vocab.CONDITIONS, modal=vocab.MODALS, limit=vocab.CONSTRAINTS, noun=vocab.DETERMINERS, joint=vocab.CONJUNCTIONS,
    offer=vocab.OFFER, bridge=vocab.OFFER_BRIDGE, interface=vocab.INTERFACE,
)
EARS = Grammar(RUPP, order=vocab.EARS_ROLES, condition=vocab.EARS_CONDITIONS, offer=(), interface=())

#: Grammars by name; add own ones here.
GRAMMARS = {"IREB-Rupp": RUPP, "EARS": EARS}
