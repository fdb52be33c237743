"""Known secrets, masked in every form in which a text or URL can show them.

One automaton finds all forms of all secrets in one pass over a text, however
many there are: each secret as it is, quoted and plus-quoted, with hexadecimal
digits of either case.  Of matches that overlap, the leftmost and then the
longest is masked, so no rest of a longer secret stays behind.
"""

from __future__ import annotations

import re
from functools import lru_cache
from urllib.parse import quote, quote_plus

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = "[MASKED]"


def forms(secret: str) -> list[str]:
    """How a secret can be written: plain and by the rules of paths, of single components and of forms."""
    return list(dict.fromkeys((secret, quote(secret, safe=""), quote(secret), quote_plus(secret), _small_digits(quote(secret, safe="")), _small_digits(quote_plus(secret)))))


def _small_digits(coded: str) -> str:
    return re.sub("%[0-9A-F]{2}", lambda m: m.group().lower(), coded)


def _large_digits(text: str) -> str:
    """Escapes with capital digits; every character keeps its place."""
    return re.sub("%[0-9A-Fa-f]{2}", lambda m: m.group().upper(), text) if "%" in text else text


@lru_cache(maxsize=16)
def automaton(secrets: tuple[str, ...]) -> ahocorasick.Automaton | None:
    """The worker's automaton for some secrets; none if all are empty."""
    found = ahocorasick.Automaton()
    for secret in secrets:
        for form in forms(secret) if secret else ():
            found.add_word(_large_digits(form), len(form))
    if not len(found):
        return None
    found.make_automaton()
    return found


def masked(text: str, secrets: tuple[str, ...]) -> str:
    tree = automaton(secrets)
    if tree is None:
        return text
    out, at = [], 0
    for last, size in tree.iter_long(_large_digits(text)):
        out += [text[at : last + 1 - size], MASK]
        at = last + 1
    return "".join(out) + text[at:] if out else text


def mask_known(text: Column, secrets: tuple[str, ...]) -> Column:
    """``text`` with every form of every secret masked; null stays null, and empty secrets hide nothing."""
    own = tuple(s for s in secrets if s)
    if not own:
        return text
    return F.pandas_udf(lambda s: s.map(lambda t: masked(t, own), na_action="ignore").astype(object).where(s.notna(), None), "string", F.PandasUDFType.SCALAR)(text)


def count_known(texts: pd.Series, secrets: tuple[str, ...]) -> int:
    """Places of secrets in some texts, for audits of what has been written."""
    tree = automaton(tuple(s for s in secrets if s))
    return 0 if tree is None else sum(1 for t in texts.dropna() for _ in tree.iter_long(_large_digits(t)))
