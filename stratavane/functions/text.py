"""Captions, vocabularies and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def caption(text: Column) -> Column:
    """Lower case, trimmed, with a full stop at the end."""
    t = F.trim(F.lower(text))
    return F.when(t.endswith("."), t).otherwise(F.concat(t, F.lit(".")))


def chunks(names: Column, size: int, joiner: str = ".") -> Column:
    """An array of names in chunks of ``size``, each joined."""
    n = F.ceil(F.size(names) / F.lit(size)).cast("int")
    empty = F.array().cast("array<string>")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(names, i * size + 1, F.lit(size)), joiner))).otherwise(empty)


def query_classes(text: Column, others: str = "others") -> Column:
    """The classes of a free-text query "a.b", with a class for everything else."""
    return F.concat(F.filter(F.transform(F.split(text, r"\."), lambda x: F.trim(x)), lambda x: x != ""), F.array(F.lit(others)))


def tags(text: Column) -> Column:
    """The tags of "a | b"."""
    return F.transform(F.split(text, r"\|"), lambda x: F.trim(x))


def processed_name(name: Column, remove_period: bool = False) -> Column:
    """Underscores become spaces, slashes "or"."""
    out = F.lower(F.replace(F.replace(name, F.lit("_"), F.lit(" ")), F.lit("/"), F.lit(" or ")))
    return F.rtrim(F.regexp_replace(out, r"\.+$", "")) if remove_period else out


def article(name: Column) -> Column:
    return F.when(F.lower(F.substring(name, 1, 1)).isin(*"aeiou"), "an").otherwise("a")


def matches_class(phrase: Column, name: Column) -> Column:
    """Whether a detected phrase names a class: either contains the other."""
    return phrase.contains(name) | name.contains(phrase)


def strip_affixes(name: Column, prefix: str = "", suffix: str = "") -> Column:
    out = F.when(name.startswith(prefix), F.substr(name, F.lit(len(prefix) + 1))).otherwise(name) if prefix else name
    return F.when(out.endswith(suffix), F.substr(out, F.lit(1), F.length(out) - len(suffix))).otherwise(out) if suffix else out


def numbered(prefix: Column, number: Column, width: int = 3) -> Column:
    """"name_007"."""
    return F.concat_ws("_", prefix, F.lpad(number.cast("string"), width, "0"))


def phrase_of(tokens: Column, logits: Column, threshold: float) -> Column:
    """The tokens whose logit exceeds the threshold, as a phrase without full stops."""
    kept = F.filter(F.zip_with(tokens, logits, lambda t, v: F.when(v > threshold, t)), lambda t: t.isNotNull() & (t != "."))
    return F.array_join(kept, " ")
