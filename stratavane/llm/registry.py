"""The corpus operators' queries and SQL, by name."""

from __future__ import annotations

import functools

from stratavane import storage
from stratavane.llm import clustering, conversations, decontamination, exact, language, licenses, mixing, near, pieces, pii, substrings, token_counts, token_files

_MODULES = [near, pieces, language, token_counts, pii, decontamination, exact, token_files, licenses, substrings, mixing, clustering, conversations]


#: The token files are op8's output and stay where they were written.
_KEEP_FILES = {"op8_token_files"}


def _tidy(name: str, f):
    """``f`` with its result written, so that the tables it has staged on the way can go."""

    @functools.wraps(f)
    def run(spark, sf_dir):
        path = storage.new_path(spark, name)
        with storage.scratch(spark):
            return storage.stage(f(spark, sf_dir), name, path)

    return run


def queries() -> dict:
    own = {n: f if n in _KEEP_FILES else _tidy(n, f) for m in _MODULES for n, f in vars(m).items() if n.startswith("op") and n[2:3].isdigit() and callable(f)}
    return own | {"language_of_pages": language.language_of_pages}


def oracle_sql() -> dict[str, str]:
    return {n: m.SQL for m in _MODULES for n in vars(m) if n.startswith("op") and n[2:3].isdigit() and getattr(m, "SQL", None)}
