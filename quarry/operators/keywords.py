"""Many keywords in one pass over each text: an Aho-Corasick automaton over a table of words, made once and sent to every worker."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The automaton goes to every worker; larger tables of words raise an error.
MOST_WORDS = 1_000_000
#: Texts whose strings and results a worker holds as Python objects at a time.
SLICE_ROWS = 128
#: The white space of the Unicode standard, which ``strip`` takes off.
WHITE = frozenset("\t\n\x0b\x0c\r \x85\xa0                　")


def _by_slices(texts: pa.Array, f: Callable[[str | None], list], kind: pa.DataType) -> pa.Array:
    """f of each text; a batch has 10,000 of them, so all but a slice stay as Arrow holds them."""
    parts = [pa.array([f(t) for t in texts.slice(begin, SLICE_ROWS).to_pylist()], kind) for begin in range(0, len(texts), SLICE_ROWS)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


class Keywords:
    """The words of a table ``words`` (word), found wherever a text contains them, inside other words too.

    Null and empty words are ignored, repeated ones count once.  Null and empty texts hold no words.  A text takes time in
    proportion to its length and its occurrences, whatever the number of words; the automaton is made on the driver.
    """

    def __init__(self, words: DataFrame):
        rows = words.where("word <> ''").select("word").distinct().limit(MOST_WORDS + 1).collect()
        if len(rows) > MOST_WORDS:
            raise ValueError(f"more than {MOST_WORDS} keywords")
        found = sorted(r["word"] for r in rows)
        automaton = None
        if found:
            automaton = ahocorasick.Automaton()
            for number, word in enumerate(found):
                automaton.add_word(word, (number, len(word)))
            automaton.make_automaton()
        self._shared = words.sparkSession.sparkContext.broadcast((automaton, found))

    def mentions(self, text: Column) -> Column:
        """The distinct words that the text contains, in the order of their code points."""
        shared = self._shared

        @F.arrow_udf("array<string>")
        def words_in(texts: pa.Array) -> pa.Array:
            automaton, words = shared.value
            return _by_slices(texts, lambda t: [words[n] for n in sorted({n for _, (n, _) in automaton.iter(t)})] if automaton and t else [], pa.list_(pa.string()))

        return words_in(text)

    def counts(self, text: Column) -> Column:
        """(word, n) for each word that the text contains, with all its occurrences, overlapping ones too."""
        shared = self._shared

        def counted(t: str | None) -> list[dict]:
            automaton, words = shared.value
            n_of: dict[int, int] = {}
            for _, (n, _) in automaton.iter(t) if automaton and t else ():
                n_of[n] = n_of.get(n, 0) + 1
            return [{"word": words[n], "n": n_of[n]} for n in sorted(n_of)]

        @F.arrow_udf("array<struct<word:string,n:long>>")
        def counts_in(texts: pa.Array) -> pa.Array:
            return _by_slices(texts, counted, pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())])))

        return counts_in(text)

    def phrases(self, text: Column, stops: str = ".\n", shortest: int = 8, longest: int = 50) -> Column:
        """Phrases that begin with a word and run up to the next of the characters ``stops``, or to the end of the text.

        The same as ``extract_patterns`` with a pattern ``word[^stops]*`` for each word: in the words' order, stripped, of
        ``shortest`` to ``longest`` characters, no overlaps between phrases of one word, no repeats.
        """
        shared = self._shared

        def phrases_of(t: str | None) -> list[str]:
            automaton, words = shared.value
            if not automaton or not t:
                return []
            ends = [i for i, c in enumerate(t) if c in stops]
            free: dict[int, int] = {}
            found: dict[int, list[str]] = {}
            for last, (n, length) in automaton.iter(t):
                begin = last + 1 - length
                if begin < free.get(n, 0):
                    continue
                at = bisect_left(ends, last + 1)
                end = free[n] = ends[at] if at < len(ends) else len(t)
                while begin < end and t[begin] in WHITE:
                    begin += 1
                while begin < end and t[end - 1] in WHITE:
                    end -= 1
                if shortest <= end - begin <= longest:
                    found.setdefault(n, []).append(t[begin:end])
            return list(dict.fromkeys(phrase for n in sorted(found) for phrase in found[n]))

        @F.arrow_udf("array<string>")
        def phrases_in(texts: pa.Array) -> pa.Array:
            return _by_slices(texts, phrases_of, pa.list_(pa.string()))

        return phrases_in(text)
