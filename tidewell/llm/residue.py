"""Template residue, filler and error pages among documents.

A document is divided into segments (lines and sentences). Open places of templates are found by their form. Whether
a segment is a notice, an error message or filler is decided by evidence from the whole collection: a first guess
learned from a few labelled examples, the words that stand in such texts and in others, whether the segment stands
alone, and whether several hosts repeat it. A document is residue when such segments are all that it holds.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.examples import ORDINARY, RESIDUE
from tidewell.llm.places import MAY_HOLD, open_places
from tidewell.operators.skew import join_spread
from tidewell.session import cut

BLANKS = re.compile(r"[  -​　﻿\t]")
DIVIDE = re.compile(r"[\r\n]+|(?<=[.!?])['\")\]]*\s+(?=[^\W_]|[<\[({$'\"%_#])")
WORD = re.compile(r"(?<!\w)[^\W\d_]{2,}(?:['’][^\W\d_]+)?(?!\w)")
CODE = re.compile(r"(?<![\w.,])[45]\d\d(?![\w.,]\d|%)")
CRUMBS = frozenset("|>»/·")
BREADCRUMBS = re.compile(r"\s[|>»/·]\s")
ENDED = re.compile(r"[.!?]['\")\]]*$")
# Single lines around a page's content.
FURNITURE = re.compile(
    r"^\W*(?:home|menu|search|alerts|sign in|log ?in|log ?out|contact(?: us| support)?|skip to content|terms(?: of (?:use|service))?|privacy(?: policy)?|imprint|back(?: to \w+)?|share|print|"
    r"all rights reserved|copyright.*|©.*|navigation|subscribe|newsletter|next|previous|help|about(?: us)?)\W*$",
    re.IGNORECASE,
)
#: A segment stands alone in a document that holds fewer words of other, unexplained content, each sentence counted once.
RICH_WORDS = 15
#: Words of proper content that a page around residue may hold, and as a share of the residue; twice as many where title and body share no word.
SPARE_WORDS, SPARE_SHARE = 7, 0.15
#: A title is a first line of at most so many words without a sentence's end.
TITLE_WORDS = 8
#: Log odds of residue before anything is known of a document or a segment, and the most that the examples say of one.
DOCUMENT_ODDS, SEGMENT_ODDS, MOST_GUESS = -2.0, -1.0, 6.0
#: Half the documents' worth of weight by which a word's odds are drawn to the collection's.
SHRINK = 4.0
#: Weight of a segment that several hosts repeat from which on its own behaviour counts for more than its words.
KNOWN_WEIGHT = 8.0
#: What is added to the counts of words among the examples.
FEW = 0.3
#: Most that one word adds or takes.
MOST_WORD = 3.0
#: A possible place counts if it is one of several in the document or is left open in so many documents of so many hosts.
SHARED_DOCUMENTS, SHARED_HOSTS = 3, 2
#: Judgements of segments that one process keeps.
MEMORY = 200_000


class Guess:
    """The first guess: log odds of residue from words and pairs of words, learned from the labelled examples."""

    def __init__(self) -> None:
        counts = {True: Counter(), False: Counter()}
        for label, lines in ((True, RESIDUE), (False, ORDINARY)):
            for line in lines:
                counts[label].update(set(self.features(terms_of(line))))
        sizes = {label: len(lines) for label, lines in ((True, RESIDUE), (False, ORDINARY))}
        self.odds = {
            f: math.log((counts[True][f] + FEW) / (sizes[True] + 1)) - math.log((counts[False][f] + FEW) / (sizes[False] + 1))
            for f in set(counts[True]) | set(counts[False])
        }

    @staticmethod
    def features(terms: list[str]) -> list[str]:
        return terms + [f"{a} {b}" for a, b in zip(terms, terms[1:])]

    def __call__(self, terms: list[str]) -> float:
        said = [self.odds.get(f, 0.0) for f in dict.fromkeys(self.features(terms))]
        return max(-MOST_GUESS, min(MOST_GUESS, sum(said)))


def terms_of(segment: str) -> list[str]:
    """The words of a segment in lower case, without numbers and names of single letters; a short one's error code is a word."""
    words = WORD.findall(segment.lower())
    return ["#code", *words] if len(words) <= 6 and CODE.search(segment) else words


_guess: list[Guess] = []
_memory: dict[str, tuple[int, float]] = {}


def judge(text: str) -> tuple[int, float, str]:
    """Hash, first guess and terms of a segment's joined terms, from memory if it was seen before."""
    known = _memory.get(text)
    if known is None:
        if not _guess:
            _guess.append(Guess())
        if len(_memory) >= MEMORY:
            _memory.clear()
        known = _memory[text] = (xxhash.xxh64_intdigest(text) - (1 << 63), _guess[0](text.split(" ")) if text else 0.0)
    return known


SEGMENT = T.StructType(
    [T.StructField("row", T.LongType()), T.StructField("host", T.StringType()), T.StructField("key", T.LongType()), T.StructField("words", T.IntegerType()), T.StructField("guess", T.FloatType()),
     T.StructField("belongs", T.FloatType()), T.StructField("alone", T.IntegerType()), T.StructField("is_content", T.BooleanType()), T.StructField("is_title", T.BooleanType()), T.StructField("mismatch", T.BooleanType()),
     T.StructField("certain", T.IntegerType()), T.StructField("possible", T.ArrayType(T.LongType())), T.StructField("terms", T.StringType())]
)


def read(row: int, host: str | None, text: str) -> list[tuple]:
    """The rows of segments for one document, but for their terms."""
    parts = [p.strip() for p in DIVIDE.split(BLANKS.sub(" ", text))]
    parts = [p for p in parts if p]
    if not parts:
        return []
    certain, possible = 0, set()
    if MAY_HOLD.search(text):
        for p in parts:
            if MAY_HOLD.search(p):
                sure, maybe = open_places(p)
                certain += sure
                possible |= maybe
    found = []
    for p in parts:
        terms = terms_of(p)
        joined = " ".join(terms)
        key, guess = judge(joined)
        crumbs = not CRUMBS.isdisjoint(p) and BREADCRUMBS.search(p) and not ENDED.search(p)
        furniture = crumbs or (len(terms) <= TITLE_WORDS and FURNITURE.match(p))
        found.append((key, len(terms), guess, not furniture and bool(terms), joined))
    content = [f for f in found if f[3]]
    title = len(content) > 1 and content[0][1] <= TITLE_WORDS and not ENDED.search(parts[found.index(content[0])])
    mismatch = False
    if title:
        body = {t for f in content[1:] for t in f[4].split(" ")}
        slug = set(content[0][4].split(" ")) | set(re.findall(r"[^\W_]+", (host or "").lower()))
        mismatch = not slug & body
        content = content[1:]
    odds = DOCUMENT_ODDS + sum(f[2] for f in content) / max(1.0, math.sqrt(len(content)))
    belongs = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    least = 0.0 if odds > 0 else 1e-9
    by_key = {f[0]: f[1] for f in content if f[2] < least}
    other = sum(by_key.values())
    first = True
    out = []
    for key, words, guess, is_content, joined in found:
        is_title = title and first and is_content
        first = first and not is_content
        out.append((row, host, key, words, guess, belongs, int(other - by_key.get(key, 0) < RICH_WORDS), is_content, is_title, mismatch, 0, None, joined))
    sure = certain + (len(possible) if len(possible) > 1 else 0)
    hashes = [xxhash.xxh64_intdigest(p) - (1 << 63) for p in sorted(possible)] or None
    out[0] = (*out[0][:10], sure, hashes, out[0][12])
    return out


def segments(documents: DataFrame, row_id: str, text: str, host: str) -> DataFrame:
    """One row per line or sentence: row, host, key (hash of its words), words, guess, belongs (first guess for its document), alone,
    is_content (no furniture), is_title, mismatch (title and body share no word), certain and possible (open places, in
    a document's first row) and terms (its words, once per task for each key)."""

    schema = pa.schema([
        ("row", pa.int64()), ("host", pa.string()), ("key", pa.int64()), ("words", pa.int32()), ("guess", pa.float32()), ("belongs", pa.float32()), ("alone", pa.int32()), ("is_content", pa.bool_()),
        ("is_title", pa.bool_()), ("mismatch", pa.bool_()), ("certain", pa.int32()), ("possible", pa.list_(pa.int64())), ("terms", pa.string()),
    ])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[int] = set()
        for batch in batches:
            rows = [r for document in zip(*[c.to_pylist() for c in batch.columns]) for r in read(*document)]
            if len(told) > MEMORY:
                told = set()
            terms: list[str | None] = []
            for r in rows:
                terms.append(None if r[2] in told else r[12])
                told.add(r[2])
            columns = [*zip(*rows)][:12] if rows else [[]] * 12
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip([*columns, terms], schema.types)], schema=schema)

    held = documents.where(F.col(row_id).isNotNull() & F.col(text).isNotNull()).select(F.col(row_id).cast("long").alias("row"), F.col(host).cast("string").alias("host"), F.col(text).alias("text"))
    return held.mapInArrow(each, SEGMENT)


def key_evidence(marked: DataFrame) -> DataFrame:
    """Per key: weight, guess, terms, share (how much of it is residue by guess and standing alone) and odds that its hosts give.

    Each (key, host) is counted by itself; a host weighs by the root of its count, so one that repeats a sentence
    doesn't outvote several. What a single host says gives no odds; from three hosts on it counts in full.
    """
    content = marked.where("is_content")
    hosts = content.groupBy("key", "host").agg(F.count("*").alias("n"), F.avg("alone").alias("alone"), F.avg("belongs").alias("belongs"), F.max("guess").alias("guess"), F.avg(F.col("mismatch").cast("int")).alias("mismatch"))
    weight = F.sqrt("n")
    keys = hosts.groupBy("key").agg(
        F.sum(weight).alias("weight"), F.sum(weight * F.col("alone")).alias("alone"), F.sum(weight * F.col("belongs")).alias("belongs"), F.sum(weight * F.col("mismatch")).alias("mismatch"),
        F.count("*").alias("hosts"), F.max("guess").alias("guess"),
    )
    alone = F.col("alone") / F.col("weight")
    shared = F.least(F.col("hosts") - 1, F.lit(2)) / F.lit(2.0)
    odds = shared * 2 * F.log((F.col("alone") + 0.5) / (F.col("weight") - F.col("alone") + 0.5))
    guessed = F.col("belongs") / F.col("weight")
    repeated = F.when((F.col("hosts") >= 3) & (alone >= 0.6), 0.7).otherwise(0.0)
    share = guessed * (F.col("alone") + 0.5) / (F.col("weight") + 0.75) + (1 - guessed) * repeated
    words = marked.where("is_content and terms is not null").groupBy("key").agg(F.max("terms").alias("terms"))
    return keys.select("key", "weight", "guess", share.alias("share"), odds.alias("odds"), shared.alias("shared")).join(words, "key")


def word_scores(keys: DataFrame) -> DataFrame:
    """Per key the score from its words: the log odds that each has in the rest of the collection. keys is read several times."""
    total = keys.select((F.col("weight") * F.size(F.split("terms", " "))).alias("w"), "share").agg(F.sum(F.col("w") * F.col("share")).alias("r"), F.sum("w").alias("n")).first()
    rate = min(0.9, max(0.001, (total["r"] or 0.0) / total["n"])) if total["n"] else 0.5
    own = keys.select("key", (F.col("weight") * F.col("share")).alias("own_r"), (F.col("weight") * (1 - F.col("share"))).alias("own_p"), F.explode(F.array_distinct(F.split("terms", " "))).alias("term")).where("term <> ''")
    words = own.groupBy("term").agg(F.sum("own_r").alias("r"), F.sum("own_p").alias("p"))
    both = join_spread(own, words, on=["term"], key="term", spread="key")
    r, p = F.col("r") - F.col("own_r") + SHRINK * rate, F.col("p") - F.col("own_p") + SHRINK * (1 - rate)
    odds = F.log(F.greatest(r, F.lit(1e-6)) / F.greatest(p, F.lit(1e-6))) - math.log(rate / (1 - rate))
    return both.groupBy("key").agg(F.sum(F.greatest(F.lit(-MOST_WORD), F.least(F.lit(MOST_WORD), odds))).alias("words_say"))


def flag_residue(documents: DataFrame, *, row_id: str, text: str, host: str, host_evidence: bool = True) -> DataFrame:
    """Every document's verdict: row_id, has_places, is_residue, residue_words, other_words, flagged.

    has_places: a template's place was left open in a sentence that doesn't speak of the place; a form that means other
    things as well counts if the document has several or the same one is left open elsewhere. is_residue: it holds
    segments that the evidence calls notice, error or filler and, besides them, its title and page furniture,
    hardly a word. Same texts get the same verdict. host_evidence=False leaves out what standing alone on several hosts says.

    row_id must be a whole number. Null and empty texts hold nothing and aren't flagged; a null host is a host of its own. Rows
    with a null row_id are left out; rows that repeat a row_id are one document. Empty input gives no rows.
    """
    marked = cut(segments(documents, row_id, text, host))
    keys = key_evidence(marked)
    if not host_evidence:
        keys = keys.withColumn("odds", F.lit(0.0)).withColumn("shared", F.lit(0.0)).withColumn("share", F.when(F.col("guess") > 0, 0.5).otherwise(0.0))
    keys = cut(keys)
    told = (F.col("guess") + F.coalesce("words_say", F.lit(0.0))) / (1 + F.col("weight") * F.col("shared") / KNOWN_WEIGHT)
    score = F.lit(SEGMENT_ODDS) + F.col("odds") + told
    judged = keys.join(word_scores(keys), "key", "left").select("key", (score > 0).alias("is_bad"))
    content = marked.where("is_content").select("row", "key", "words", "is_title", "mismatch")
    each = join_spread(content, judged, on=["key"], key="key", spread="row")
    sums = each.groupBy("row").agg(
        F.sum(F.when(F.col("is_bad"), F.col("words")).otherwise(0)).alias("residue_words"), F.sum(F.when(F.col("is_bad") | F.col("is_title"), 0).otherwise(F.col("words"))).alias("other_words"), F.max("mismatch").alias("mismatch")
    )
    spare = F.greatest(F.lit(float(SPARE_WORDS)), F.col("residue_words") * SPARE_SHARE) * F.when(F.col("mismatch"), 2).otherwise(1)
    sums = sums.select("row", "residue_words", "other_words", ((F.col("residue_words") > 0) & (F.col("other_words") <= F.least(spare, F.col("residue_words") * 2.0))).alias("is_residue"))
    return _with_places(documents.where(F.col(row_id).isNotNull()).select(row_id).distinct(), sums, marked, row_id)


def _with_places(ids: DataFrame, sums: DataFrame, marked: DataFrame, row_id: str) -> DataFrame:
    places = marked.where("certain > 0 or possible is not null").select("row", "host", "certain", F.explode_outer("possible").alias("possible"))
    shared = places.where("possible is not null").groupBy("possible", "host").agg(F.count("*").alias("n")).groupBy("possible").agg(F.sum("n").alias("n"), F.count("*").alias("hosts"))
    shared = shared.where((F.col("n") >= SHARED_DOCUMENTS) & (F.col("hosts") >= SHARED_HOSTS)).select("possible", F.lit(True).alias("is_shared"))
    joined = join_spread(places, shared, on=["possible"], key="possible", spread="row", how="left")
    open_ = joined.where("certain > 0 or is_shared").select("row", F.lit(True).alias("has_places")).distinct()
    no = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    out = ids.withColumn("row", F.col(row_id).cast("long")).join(sums, "row", "left").join(open_, "row", "left")
    out = out.select(row_id, no("has_places", False), no("is_residue", False), no("residue_words", 0), no("other_words", 0))
    return out.withColumn("flagged", F.col("has_places") | F.col("is_residue"))


