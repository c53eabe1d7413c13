"""Rewrites of criteria in Arrow batches: what `functions.surface` says of a column, for one text after the other.

A pattern that begins a text is matched there alone, and one that needs a word is sought only where the text has the word.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

from sievecraft.functions import surface as sf
from sievecraft.functions import tasks
from sievecraft.functions.dimensions import ACTIONS


def rewritten(rows: DataFrame, last: bool = False) -> DataFrame:
    """rows (item, kind and others) with their items in final wording, without poor ones. Before the last step items are candidates:
    those that are not `worded` lose label, question and opening first, and those that begin badly are worded once more."""
    openings, shells, rounds, rest, fixes, questions = sf.OPENINGS, sf.SHELLS, sf.ROUND, sf.REST, tasks.SENTENCE_FIXES, tasks.QUESTION_RULES
    opening_words, shell_words, rest_words, fixed_words, surface_words = sf.OPENING_WORDS, sf.SHELL_WORDS, sf.REST_WORDS, tasks.FIXED_WORDS, sf.SURFACE_WORDS
    round_starts, bad_starts, bad_surface, bad_grammar, label = f"^(?:{sf.ROUND_STARTS})", f"{sf.BAD_PREFIX}|{sf.ASKS}", sf.BAD_SURFACE, sf.BAD_GRAMMAR, tasks.LABEL
    acts, verb_starts, verbs, most = rf"^(?:{ACTIONS})\b", tasks.VERB_STARTS, tasks.TASK_VERBS, sf.MOST_ROUNDS

    # Defined here, so that executors need no copy of this module.
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import functools
        import re

        import numpy as np
        import pyarrow as pa

        rules = lambda pairs: [(p.startswith("^"), re.compile(p, re.IGNORECASE), form) for p, form in pairs]
        any_case = lambda p: re.compile(p, re.IGNORECASE)
        opened, unshell, rounded, ended, fixed, asked = map(rules, (openings, shells, rounds, rest, fixes, questions))
        starts, badly, worn, grammar, labelled, acting = any_case(round_starts), any_case(bad_starts), any_case(bad_surface), any_case(bad_grammar), re.compile(label), re.compile(acts)

        def changed(x: str, some: list, words: tuple = ()) -> str:
            if words:
                low = x.lower()
                if not any(w in low for w in words):
                    return x
            for front, pattern, form in some:
                if not front:
                    x = pattern.sub(form, x)
                elif m := pattern.match(x):
                    x = form + x[m.end() :]
            return x

        @functools.lru_cache(64)  # most rewrites leave a text as it is
        def tidy(x: str) -> str:
            # Python's white space is that of the rules.
            x = changed(" ".join(x.split()).strip(" \"'"), fixed, fixed_words).rstrip(".;?")
            return x and x + "."

        def unlabelled(x: str) -> str:
            m = labelled.match(x)
            return m.group(1).strip() if m else x

        def stated(x: str) -> str:
            x = unlabelled(tidy(x))
            bare = x.rstrip(".").rstrip("?").strip()
            for _, pattern, form in asked:
                if m := pattern.match(bare):
                    return tidy(tidy(m.expand(form)))
            return tidy(x)

        def verbal(x: str, kind: str) -> str:
            if acting.match(x) or x.lower().startswith(verb_starts):
                return x
            return f"{verbs.get(kind, verbs[''])} {x[:1].lower()}{x[1:]}"

        def imperative(x: str, kind: str) -> str:
            return tidy(verbal(tidy(changed(tidy(unlabelled(x)), opened, opening_words)), kind))

        @functools.lru_cache(64)
        def surface(x: str) -> str:
            x = tidy(x)
            if not x:
                return ""
            was, x = None, changed(x, unshell, shell_words)
            for _ in range(most):
                if was == x:
                    break
                was, x = x, tidy(changed(x, rounded) if starts.match(x) else x)
            if was != x:
                raise ValueError(f"still changing after {most} rounds: {x}")
            x = tidy(changed(x, ended, rest_words))
            return tidy(x and verbal(x, "general_task"))

        def poor(x: str) -> bool:
            x = tidy(x)
            low = x.lower()
            return not x or "a" <= x[0] <= "z" or bool(grammar.match(x)) or (any(w in low for w in surface_words) and bool(worn.search(x)))

        def worded(x: str, kind: str, ready: bool) -> str | None:
            if last:
                x = surface(imperative(x, kind))
                return None if poor(x) else x
            x = tidy(surface(x if ready else surface(imperative(stated(x), kind))))
            if poor(x):
                return None
            x = surface(imperative(x, kind) if badly.match(x) else x)
            return None if poor(x) else x

        for batch in batches:
            ready = [False] * batch.num_rows if last else batch.column("worded").to_pylist()
            done = [worded(*row) for row in zip(batch.column("item").to_pylist(), batch.column("kind").to_pylist(), ready, strict=True)]
            at = pa.array(np.flatnonzero(np.array([x is not None for x in done], bool)))
            columns = {c: batch.column(c).take(at) for c in names} | {"item": pa.array([x for x in done if x is not None], pa.string())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    names = [c for c in rows.columns if c not in ("item", "worded")]
    kept = rows.where("item IS NOT NULL")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema), "item string"])
    return kept.mapInArrow(run, schema)
