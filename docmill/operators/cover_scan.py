"""Matches of many queries in a batch of chunks, and their cover density, on arrays of numbers.

The words of all queries are numbered once. A batch of chunks becomes the list of its asked words by
place; what a query needs to know (which chunks hold a word, how often, where) are slices of that list.
The results are those of ``fulltext.cover_density``, with every sum taken in the same order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WEIGHT = 0.1  # weight of a word without a label
BATCH_WORDS = 1_000_000  # words of chunks looked at together; a longer chunk is taken by itself
SAME = 2e-12  # scores this near may be equal once they are rounded to 12 digits


class Query(NamedTuple):
    """Words as numbers: ``alternatives`` are (lead, items), an item (negated, words), with -1 for any
    word and for no lead; ``alone`` are the groups of one word, ``several`` the others."""

    alternatives: list
    alone: list
    several: list
    terms: list


Lead = Callable[[list[str]], str]


def numbered_queries(alternatives: list, lead: Lead) -> tuple[list[str], list[Query]]:
    """The words of parsed queries in the order of their numbers, and the queries. ``lead`` picks one
    of the words that an alternative cannot do without."""
    number: dict[str, int] = {"": -1}

    def of(word: str) -> int:
        return number.setdefault(word, len(number) - 1)

    queries = []
    for parsed in alternatives:
        told, groups = [], []
        for items in parsed:
            needed = list(dict.fromkeys(w for it in items if not it["negated"] for w in it["words"] if w))
            told.append((of(lead(needed)) if needed else -1, [(it["negated"], [of(w) for w in it["words"]]) for it in items]))
            if needed:
                groups.append([of(w) for w in needed])
        alone = list(dict.fromkeys(g[0] for g in groups if len(g) == 1))
        several = [list(g) for g in dict.fromkeys(tuple(g) for g in groups if len(g) > 1)]
        queries.append(Query(told, alone, several, list(dict.fromkeys(w for g in groups for w in g))))
    return list(number)[1:], queries


class Places:
    """Where the asked words stand in a batch of chunks. A place counts through all chunks."""

    def __init__(self, tokens: pa.ListArray, words: pa.Array) -> None:
        lengths = np.asarray(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        found = pc.index_in(tokens.flatten(), value_set=words)
        self.words = pc.fill_null(found, -1).to_numpy(zero_copy_only=False)
        self.size, self.ends = len(lengths), np.cumsum(lengths)
        self.known = tokens.is_valid().to_numpy(zero_copy_only=False)
        asked = np.flatnonzero(self.words >= 0)
        asked = asked[np.argsort(self.words[asked], kind="stable")]
        every = np.arange(len(words) + 1)
        self.places, self.chunks = asked, np.searchsorted(self.ends, asked, side="right")
        word = self.words[asked]
        self.bounds = np.searchsorted(word, every)
        # a word and a chunk that holds it, with the number of times
        new = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (self.chunks[1:] != self.chunks[:-1])][: len(word)])
        self.holders, self.times = self.chunks[new], np.diff(np.r_[new, len(word)])
        self.holder_bounds = np.searchsorted(word[new], every)

    def holding(self, word: int) -> tuple[np.ndarray, np.ndarray]:
        """The chunks with a word, each once, and how often they have it."""
        part = slice(self.holder_bounds[word], self.holder_bounds[word + 1])
        return self.holders[part], self.times[part]

    def at(self, word: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.bounds[word], self.bounds[word + 1])
        return self.places[part], self.chunks[part]

    def with_phrase(self, words: list[int]) -> np.ndarray:
        """The chunks in which the words stand side by side; -1 is any word."""
        if len(words) == 1:
            return self.holding(words[0])[0]
        rarest = min((j for j, w in enumerate(words) if w >= 0), key=lambda j: self.bounds[words[j] + 1] - self.bounds[words[j]])
        places, chunks = self.at(words[rarest])
        first = places - rarest
        begins = self.ends[chunks - 1] * (chunks > 0)
        keep = (first >= begins) & (first + len(words) <= self.ends[chunks])
        first, chunks = first[keep], chunks[keep]
        for j, w in enumerate(words):
            if w >= 0 and j != rarest:
                keep = self.words[first + j] == w
                first, chunks = first[keep], chunks[keep]
        return chunks

    def matching(self, query: Query) -> np.ndarray:
        """True for the chunks that satisfy an alternative."""
        found = np.zeros(self.size, bool)
        for lead, items in query.alternatives:
            left = np.flatnonzero(self.known) if lead < 0 else self.holding(lead)[0]
            if items != [(False, [lead])]:
                for negated, words in items:
                    held = np.zeros(self.size, bool)
                    held[self.with_phrase(words)] = True
                    left = left[held[left] != negated]
            found[left] = True
        return found

    def densities(self, query: Query, found: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """Cover density of the chunks in ``found``. ``sums`` has the score of so many single words."""
        counts = np.zeros(self.size, np.int64)
        for word in query.alone:
            chunks, times = self.holding(word)
            counts[chunks] += times
        scores = sums[counts]
        walked = np.zeros(self.size, bool)
        for group in query.several:
            held = np.zeros(self.size, np.int64)
            for word in group:
                held[self.holding(word)[0]] += 1
            walked |= held == len(group)
        walked &= found
        if walked.any():
            scores[walked] = self.walk(query, walked)[walked]
        return scores

    def walk(self, query: Query, chunks: np.ndarray) -> np.ndarray:
        """Cover density by the shortest stretches, from word to word through the chunks marked."""
        places, owners, terms = [], [], []
        for word in query.terms:
            at, of = self.at(word)
            keep = chunks[of]
            places.append(at[keep])
            owners.append(of[keep])
            terms.append(np.full(len(places[-1]), word))
        places, owners, terms = map(np.concatenate, (places, owners, terms))
        order = np.argsort(places)
        places, owners, terms = places[order], owners[order], terms[order]
        hit = np.arange(len(places))
        first = np.searchsorted(owners, owners)  # of the chunk's hits

        def last(word: int) -> np.ndarray:
            return np.maximum.accumulate(np.where(terms == word, hit, -1))

        begin = np.where(np.isin(terms, query.alone), hit, -1)
        for group in query.several:
            start = last(group[0])
            for word in group[1:]:
                start = np.minimum(start, last(word))
            begin = np.maximum(begin, start)
        # the start only moves on; one before the chunk's hits is none
        begin = np.maximum.accumulate(np.where(begin >= first, begin, -1))
        begin = np.where(begin >= first, begin, -1)
        before = np.where(hit > first, np.r_[-1, begin[:-1]], -1) if len(hit) else begin
        moved = np.flatnonzero(begin > before)
        words, named = places[moved] - places[begin[moved]], moved - begin[moved]
        return np.bincount(owners[moved], WEIGHT / (1 + words - named).astype(np.float64), self.size)


def _slices(tokens: pa.ListArray) -> Iterator[tuple[int, int]]:
    """Where to cut a batch so that a part has a bounded number of words."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False), dtype=np.int64))
    at = 0
    while at < len(tokens):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + BATCH_WORDS, side="right")))
        yield at, to
        at = to


def _sorts(kind: pa.DataType) -> bool:
    return pa.types.is_integer(kind) or pa.types.is_string(kind) or pa.types.is_large_string(kind)


def _best(scores: np.ndarray, chunks: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions that can be among the first ``k`` by falling score as rounded, then by id."""
    if len(scores) <= k:
        return np.arange(len(scores))
    near = np.flatnonzero(scores >= np.partition(scores, -k)[-k] - SAME)
    near = near[np.lexsort((ids[chunks[near]], -scores[near]))]
    value = scores[near]
    starts = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
    place = np.arange(len(near)) - np.repeat(starts, np.diff(np.r_[starts, len(near)]))
    return near[place < k]


def scan(batches: Iterator[pa.RecordBatch], words: list[str], ids: pa.Array, queries: list[Query], k: int | None) -> Iterator[pa.RecordBatch]:
    """``chunk_id`` and what else a row carries before its ``tokens``, with ``hits``: the queries that
    the chunk matches, by their ids, and their scores. With ``k`` a part of a batch leaves out what
    cannot be among the first ``k`` chunks of a query."""
    asked = pa.array(words, pa.string())
    sums = np.zeros(1)
    for batch in batches:
        tokens = batch.column(batch.num_columns - 1)
        for at, to in _slices(tokens):
            part = batch.slice(at, to - at)
            places = Places(tokens.slice(at, to - at).cast(pa.list_(pa.string())), asked)
            if len(sums) <= len(places.places):  # one by one, as the hits are added up
                sums = np.cumsum(np.r_[0.0, np.full(2 * len(places.places), WEIGHT)])
            order = None
            if k is not None and _sorts(part.column(0).type):
                order = pc.rank(part.column(0), null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
            chunks, numbers, scores = [], [], []
            for no, query in enumerate(queries):
                found = places.matching(query)
                held = np.flatnonzero(found)
                if len(held):
                    score = places.densities(query, found, sums)[held]
                    if order is not None:
                        keep = _best(score, held, order, k)
                        held, score = held[keep], score[keep]
                    chunks.append(held)
                    numbers.append(np.full(len(held), no))
                    scores.append(score)
            if chunks:
                chunks, numbers, scores = map(np.concatenate, (chunks, numbers, scores))
                by = np.argsort(chunks, kind="stable")
                rows, sizes = np.unique(chunks, return_counts=True)
                hits = pa.StructArray.from_arrays(
                    [ids.take(pa.array(numbers[by])), pa.array(scores[by])], names=["query_id", "rank_cd"])
                hits = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), hits)
                kept = part.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*kept.columns[:-1], hits], names=[*kept.schema.names[:-1], "hits"])
