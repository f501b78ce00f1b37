"""Operator 7, toxicity by a lexicon that also catches misspellings.

A lexicon trie is intersected with the Levenshtein automaton of each word: the product's states
are sets of (trie node, edits so far), made when first met and kept, so a word costs one look-up
a letter and most words die after three or four. The lexicon is learned from the labels: words of
which the toxic learning rows have many and the others hardly any. What a term says about the
label, by how it was written (exactly, in lookalike characters, within some edits) and whether it
stands in a quoting context, is counted over all labelled learning rows. A document's score joins
the evidence of what it holds as independent causes (noisy-or).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.llm.common import table, written
from quillet.llm.wordtokens import in_parts

#: Where labels are few, the lexicon starts from these.
SEEDS = ("idiot", "moron", "stupid", "scum", "loser", "trash", "pathetic", "worthless", "disgusting", "clown")
#: Characters written for letters they look like.
LOOKALIKES = str.maketrans("01345789@$!|+", "oieastbgasiit")
#: Words that announce a quotation or speak of a word.
REPORTING = frozenset("said says saying called calls calling wrote writes word words term terms quote quoted quoting insult slur phrase means".split())
_OPENING, _CLOSING = "\"'“„«‘‹", "\"'”“»’›"
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”„«»‘’‹›…–—¡¿"

#: Learning rows from which the lexicon is induced, at most (the first by a hash of doc_id).
LEXICON_ROWS = 20_000
#: A term stands in this share of the toxic texts learned from, in three at least, and this share
#: of its texts is toxic. So there are 67 times as many terms at most as a toxic text has words.
_MIN_SHARE, _MIN_TEXTS, _MIN_PRECISION = 0.015, 3, 0.9
#: What a term says where it was never met that way before; _WEIGHT rows' worth.
_PRIOR = {("exact", False): 0.75, ("lookalike", False): 0.75, ("edit", False): 0.5, ("exact", True): 0.3, ("lookalike", True): 0.3, ("edit", True): 0.2}
_WEIGHT = 1.5
THRESHOLD = 0.7

_HITS = "doc_id long, hits array<struct<term: string, kind: string, quoted: boolean>>"


class Automaton:
    """All words within the allowed edits of a lexicon term. Terms under 5 letters allow none,
    those of 9 or more two, others one, in any place."""

    def __init__(self, terms: list[str]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.ends: dict[int, str] = {}
        self.allowed: list[int] = [0]
        for term in sorted(set(terms)):
            node, allowed = 0, 0 if len(term) < 5 else 1 if len(term) < 9 else 2
            self.allowed[0] = max(self.allowed[0], allowed)
            for letter in term:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.allowed.append(0)
                node = self.children[node][letter]
                self.allowed[node] = max(self.allowed[node], allowed)
            self.ends[node] = term
        self.terms = frozenset(self.ends.values())
        self.states: list[dict[int, int]] = [self._skips({0: 0})]
        self.numbers = {frozenset(self.states[0].items()): 0}
        self.steps: dict[tuple[int, str], int] = {}

    def _skips(self, state: dict[int, int]) -> dict[int, int]:
        """Add what leaving out letters of a term reaches."""
        todo = list(state.items())
        while todo:
            node, edits = todo.pop()
            if edits < self.allowed[node]:
                for child in self.children[node].values():
                    if edits + 1 <= self.allowed[child] and edits + 1 < state.get(child, 9):
                        state[child] = edits + 1
                        todo.append((child, edits + 1))
        return state

    def _step(self, number: int, letter: str) -> int:
        out: dict[int, int] = {}
        for node, edits in self.states[number].items():
            moves = [(child, edits + (own != letter)) for own, child in self.children[node].items()]
            for to, n in [*moves, (node, edits + 1)]:
                if n <= self.allowed[to] and n < out.get(to, 9):
                    out[to] = n
        out = self._skips(out)
        key = frozenset(out.items())
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(out)
        return self.numbers[key]

    def nearest(self, word: str) -> str | None:
        """The term with the fewest edits (ties: the first by name), or None."""
        number = 0
        for letter in word:
            step = self.steps.get((number, letter))
            if step is None:
                step = self.steps[number, letter] = self._step(number, letter)
            number = step
            if not self.states[number]:
                return None
        found = [
            (edits, self.ends[node]) for node, edits in self.states[number].items()
            if node in self.ends and edits <= self._own(self.ends[node])
        ]
        return min(found)[1] if found else None

    @staticmethod
    def _own(term: str) -> int:
        return 0 if len(term) < 5 else 1 if len(term) < 9 else 2

    def find(self, token: str) -> tuple[str, str] | None:
        """(term, kind) of a lower-cased token without marks at its edges."""
        if token in self.terms:
            return token, "exact"
        if not token.isalpha():
            plain = token.translate(LOOKALIKES)
            plain = "".join(c for c in plain if c.isalpha())
            if plain in self.terms:
                return plain, "lookalike"
            token = plain
        elif len(token) > 4:
            squeezed = "".join(c for i, c in enumerate(token) if not i or c != token[i - 1])
            if squeezed in self.terms:
                return squeezed, "lookalike"
        if len(token) < 4:
            return None
        term = self.nearest(token)
        return (term, "edit") if term else None


def _quoted(tokens: list[str], at: int, reach: int = 8) -> bool:
    """Whether a quotation opens before the token and closes after it, or a reporting word
    stands just before."""
    if any(t.lower().strip(_EDGE) in REPORTING for t in tokens[max(0, at - 4) : at]):
        return True
    before = next((i for i in range(at, max(-1, at - reach), -1) if tokens[i][0] in _OPENING), None)
    after = next((i for i in range(at, min(len(tokens), at + reach)) if tokens[i].rstrip(".,;:?!")[-1:] in set(_CLOSING)), None)
    return before is not None and after is not None


def hits(docs: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id and what is found in each row's whole text: each term, how it is written and whether
    it is quoted. Null and empty texts have none; every row counts; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(terms)
        known: dict[str, tuple | None] = {}
        found: dict[str, tuple] = {}
        for batch in batches:
            doc_ids, at = batch.column(0), 0
            for texts in in_parts(batch.column(1).to_pylist()):
                tokens = [t.lower().split() for t in texts]
                if len(known) > 500_000:
                    known.clear()
                    found.clear()
                for token in set().union(*tokens).difference(known):
                    known[token] = hit = automaton.find(token.strip(_EDGE))
                    if hit:
                        found[token] = hit
                rows = []
                for own in tokens:
                    row = set()
                    if not found.keys().isdisjoint(own):
                        row = {(*found[token], _quoted(own, i)) for i, token in enumerate(own) if token in found}
                    rows.append([dict(zip(("term", "kind", "quoted"), r)) for r in sorted(row)])
                kind = pa.list_(pa.struct([("term", pa.string()), ("kind", pa.string()), ("quoted", pa.bool_())]))
                yield pa.RecordBatch.from_arrays([doc_ids.slice(at, len(texts)), pa.array(rows, kind)], names=["doc_id", "hits"])
                at += len(texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, _HITS)


def held_out():
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def lexicon(docs: DataFrame, learning: DataFrame) -> list[str]:
    """Seed terms, and words that set apart the toxic texts of at most ``LEXICON_ROWS`` learning
    rows (doc_id, toxic). Copies of a text count once."""
    sample = learning.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LEXICON_ROWS)
    both = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # LEXICON_ROWS rows at most
    texts = both.where("text IS NOT NULL").groupBy("text").agg(F.max("toxic").alias("toxic"))
    words = texts.select("toxic", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("word")).where("length(word) >= 4")
    counts = words.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n"))
    enough = texts.agg(F.greatest(F.lit(_MIN_TEXTS), _MIN_SHARE * F.coalesce(F.sum("toxic"), F.lit(0))).alias("enough"))  # one row
    found = counts.join(F.broadcast(enough)).where((F.col("toxic") >= F.col("enough")) & (F.col("toxic") >= _MIN_PRECISION * F.col("n")))
    return sorted({*SEEDS, *(r["word"] for r in found.select("word").collect())})


def evidence(found: DataFrame, learning: DataFrame) -> tuple[dict[tuple, float], float]:
    """How likely each hit makes the label beyond its base rate, and the score of texts without
    any. There are six rows a term at most, whatever the spellings."""
    known = found.join(learning, "doc_id")
    totals = known.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic"), F.count_if(F.size("hits") == 0).alias("bare"), F.sum(F.when(F.size("hits") == 0, F.col("toxic"))).alias("bare_toxic")).first()
    base = ((totals["toxic"] or 0) + 0.1) / (totals["n"] + 1)
    bare = min(0.5, ((totals["bare_toxic"] or 0) + 0.01) / (totals["bare"] + 1))
    each = known.select("toxic", F.explode("hits").alias("hit")).groupBy("hit").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic"))
    beyond = lambda share: min(0.995, max(0.0, (share - base) / (1 - base)))
    weights = {(None, *k): beyond(p) for k, p in _PRIOR.items()}
    for row in each.collect():
        prior = _PRIOR[row["hit"]["kind"], row["hit"]["quoted"]]
        weights[tuple(row["hit"])] = beyond((row["toxic"] + _WEIGHT * prior) / (row["n"] + _WEIGHT))
    return weights, bare


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs``.

    ``labels`` has doc_id and toxic (0 or 1; rows with nulls are ignored, of several rows of one
    id the largest counts). Labels are learned only from rows that are not held out; rows
    without a doc_id are scored but not learned from; without any label the seed terms and priors
    decide. Null and empty texts get the score of texts without findings; repeated rows score
    alike; other columns are ignored; an empty table gives no rows.
    """
    learning = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out())
    learning = learning.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    found = written(hits(docs, lexicon(docs, learning)))
    weights, bare = evidence(found, learning)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for own in batch.column("hits").to_pylist():
                clear = 1 - bare
                for h in own:
                    how = (h["kind"], h["quoted"])
                    clear *= 1 - weights.get((h["term"], *how), weights[None, *how])
                scores.append(1 - clear)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return found.mapInArrow(run, "doc_id long, score double").select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def keep_civil(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns. Of several
    rows with one doc_id all go if one does; rows without an id stay."""
    toxic = scored(docs, labels).where("predicted = 1").select("doc_id").distinct()
    return docs.join(toxic, "doc_id", "left_anti")


def op7(spark, sf_dir: str) -> DataFrame:
    """All documents, learned from the labels of those that are not held out."""
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
