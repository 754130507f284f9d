"""Repairs of short texts that depend on what was repaired before: near-miss terms, planted typos, broken JSON answers.

Each is sequential within one short value, so it runs as an Arrow-batched helper on its own column; no shuffle.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from archivolt.functions import text as X

# A window that ends in one of these names a real place or unit and is left alone.
OWN_SUFFIX = "县市省区镇乡村军师部团"


class NearTerms:
    """Terms of three characters or more, found in windows that differ from them in exactly one character.

    Each term is filed under its masks (one character left out), so a text costs its windows, not the whole dictionary.
    """

    def __init__(self, terms: Sequence[str], suffixes: str = OWN_SUFFIX) -> None:
        self.terms = sorted(dict.fromkeys(t for t in terms if len(t) >= 3), key=lambda t: -len(t))  # terms of one length in order of the list
        self.known, self.suffixes = set(self.terms), suffixes
        self.masks: dict[tuple[int, str, str], list[int]] = defaultdict(list)
        for rank, t in enumerate(self.terms):
            for j in range(len(t)):
                self.masks[j, t[:j], t[j + 1 :]].append(rank)

    def mended(self, text: str) -> str:
        """The text with near misses replaced: longest term first, then leftmost; replaced spans are not replaced again."""
        hits = []
        for n in {len(t) for t in self.terms}:
            for i in range(len(text) - n + 1):
                w = text[i : i + n]
                if w in self.known:
                    continue
                for j in range(n):
                    for rank in self.masks.get((j, w[:j], w[j + 1 :]), ()):
                        if w[-1] == self.terms[rank][-1] or w[-1] not in self.suffixes:
                            hits.append((rank, i))
        out, taken = list(text), [False] * len(text)
        for rank, i in sorted(hits):
            t = self.terms[rank]
            if not any(taken[i : i + len(t)]):
                out[i : i + len(t)] = t
                taken[i : i + len(t)] = [True] * len(t)
        return "".join(out)


def normalize_query(c: Column, fixes: Sequence[tuple[str, str]], terms: Sequence[str]) -> Column:
    """Known misspellings mended in up to six rounds, then near misses of the terms. Null stays null.

    fixes and terms are short curated lists that travel with the plan.
    """
    near = NearTerms(terms)

    @F.pandas_udf("string")
    def mend(s: pd.Series) -> pd.Series:
        return s.map(near.mended, na_action="ignore")

    return mend(X.apply_fixes(c, fixes, rounds=6))


def with_typos(text: Column, words: Column, confusions: Mapping[str, str], most: int = 2) -> Column:
    """The text with the first occurrence of up to `most` of the words, in order, misspelt by the first fitting confusion."""
    pairs = list(confusions.items())

    @F.pandas_udf("string")
    def spoil(s: pd.Series, w: pd.Series) -> pd.Series:
        def one(t: str | None, ws: Sequence[str] | None) -> str | None:
            done = 0
            for word in ws if t is not None and ws is not None else ():
                wrong = next((word.replace(a, b, 1) for a, b in sorted(pairs, key=lambda p: p[0] == word) if a in word), None) if word else None
                if done < most and wrong and wrong != word and word in t:
                    t, done = t.replace(word, wrong, 1), done + 1
            return t

        return pd.Series([one(t, ws) for t, ws in zip(s, w, strict=True)], dtype=object)

    return spoil(text, words)


def _objects(text: str):
    """All objects that can be read from an opening brace on, leftmost first, not looking inside those found."""
    at, reader = text.find("{"), json.JSONDecoder()
    while at >= 0:
        try:
            found, end = reader.raw_decode(text, at)
            yield found
        except ValueError:
            end = at + 1
        at = text.find("{", end)


def rescued_json(text: str | None) -> str | None:
    """The answer's object: the first with entities or relations, else the first, else first to last brace; else null."""
    if not text:
        return None
    found = list(_objects(text))
    best = next((x for x in found if "entities" in x or "relations" in x), found[0] if found else None)
    return None if best is None else json.dumps(best, ensure_ascii=False)


def read_json(c: Column, schema: str) -> Column:
    """from_json of the text without code fences; only rows that it cannot read go through the helper."""
    plain = X.strip(X.sub(X.strip(c), r"(?s)^```[A-Za-z]*\s*|\s*```\z", ""))
    whole = F.try_parse_json(plain).isNotNull() & plain.startswith("{")

    @F.pandas_udf("string")
    def rescue(s: pd.Series) -> pd.Series:
        return s.map(rescued_json)

    return F.from_json(F.when(whole, plain).otherwise(rescue(F.when(~whole, c))), schema)
