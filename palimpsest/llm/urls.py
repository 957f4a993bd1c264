"""URL filters: rules first, then segmented tokens under naive Bayes.

A host's names are cut at dots, hyphens and digits; what remains is split
into words by the best unigram path (Viterbi), with word counts taken from the
text of all pages.  Host words and path tokens are hashed into ``BUCKETS``
counters and scored by multinomial naive Bayes.  The training label of a url
comes from its page, not from the tokens that are scored: it is a block
example when at least one in ``PER`` words of the visible text is one of
``seeds``, else an allow example.  Without a text column the url's own tokens
stand in for the text.

Defined cases: a null url, or one without ``://``, has empty host and path and
is allowed unless a rule says otherwise; a path that is empty does not start
with ``/``, so no rule with a path fits it; a page without words is an allow
example; repeated rows train as often as they occur; an empty table gives no
rows; with no training rows the prior alone decides (allow).  A name of more
than 253 letters, which no host has, is left whole.  Words have at most
``LONGEST`` letters; longer ones are spelled out by the unknown-word model.
The counts of all words stay a table, only the substrings of the distinct host
names are looked up in it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import ddl, forget, table, tuned, written

BUCKETS, LONGEST, PER = 1 << 15, 24, 500
#: The rules (host, path, verdict), and the seed words of blocked names.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
SEEDS = ("ads", "adult", "adware", "bet", "bets", "betting", "casino", "gambling", "hack", "jackpot", "loan", "lottery", "malware", "phishing", "pills", "poker", "porn", "sex", "slots", "spam", "track", "viagra", "warez", "xxx")
LETTERS = re.compile(r"[^\W\d_]+")
PART = re.compile(r"[^\W_]+")
NUMBER = re.compile(r"\d+")
TAG = re.compile(r"<(script|style)\b.*?</\1\s*>|<[^>]*>", re.S | re.I)
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCORED = "page_id:long host:string path:string rule:string verdict:string log_odds:double segmented:string"


def parts(url: str | None) -> tuple[str, str]:
    """Host and path of a url, as the module's defined cases say."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    tail = rest[end:]
    cut = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    return rest[:end].translate(UPPER), tail[:cut]


def ruled(host: str, path: str, rules=RULES) -> tuple[str, str] | tuple[None, None]:
    """The longest rule that fits and its verdict."""
    fits = [(len(h) + len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


class Segmenter:
    """The most probable split of a name into words of a unigram model."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        """``total`` is that of all words plus one, where ``counts`` has only those that can occur."""
        total = total or sum(counts.values()) + 1
        self.cost = {w: -math.log(n / total) for w, n in counts.items()}
        self.unknown = math.log(total) + math.log(10)
        self.split = lru_cache(100_000)(self._split)

    def _split(self, name: str) -> tuple[str, ...]:
        if len(name) > 253:  # longer than any host name: left whole
            return (name,)
        best, back = [0.0], [0]
        for j in range(1, len(name) + 1):
            options = []
            for i in range(max(0, j - LONGEST), j):
                known = self.cost.get(name[i:j])
                options.append((best[i] + (known if known is not None else self.unknown + 2.5 * (j - i)), i))
            c, i = min(options)
            best.append(c)
            back.append(i)
        out, j = [], len(name)
        while j:
            out.append(name[back[j] : j])
            j = back[j]
        return tuple(reversed(out))


def path_tokens(path: str) -> list[str]:
    return [NUMBER.sub("0", x) for x in PART.findall(path.translate(UPPER))]


def bucket(kind: str, word: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{kind}:{word}") % BUCKETS


def unigrams(texts: DataFrame, column: str, seeds: tuple[str, ...] = SEEDS) -> tuple[DataFrame, int]:
    """Table (word, n) of all words of all texts, and the sum of n.

    Tasks fold their counts before the shuffle.  ``seeds`` are always known,
    with the median count at least.
    """
    spark = texts.sparkSession
    schema = "word:string n:long"

    def count(batches):
        seen: Counter[str] = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                seen.update(x for x in LETTERS.findall(TAG.sub(" ", text).lower()) if len(x) <= LONGEST) if text else None
                if len(seen) > 400_000:
                    yield table(schema, list(seen.items()))
                    seen.clear()
        yield table(schema, list(seen.items()))

    counts = written(texts.select(column).mapInArrow(count, ddl(schema)).groupBy("word").agg(F.sum("n").alias("n")), "unigrams")
    # distinct counts: at most the root of twice the words read
    sizes = counts.groupBy("n").agg(F.count("*").alias("words")).orderBy("n").collect()
    middle, at, half = 1, 0, sum(r.words for r in sizes) // 2
    for r in sizes:
        at += r.words
        if at > half:
            middle = r.n
            break
    least = spark.createDataFrame([(w, middle) for w in sorted(set(seeds))], "word string, n long")
    held = {r.word: r.n for r in counts.join(F.broadcast(least.select("word")), "word", "left_semi").collect()}
    total = sum(r.n * r.words for r in sizes) + sum(max(0, middle - held.get(w, 0)) for w in set(seeds))
    known = counts.join(F.broadcast(least.withColumnRenamed("n", "least")), "word", "left")
    out = known.select("word", F.greatest("n", F.coalesce("least", "n")).alias("n")).unionByName(least.where(~F.col("word").isin(list(held))))
    out._palimpsest_path = counts._palimpsest_path
    return out, total


def segmented(names: DataFrame, known: DataFrame, total: int) -> DataFrame:
    """(name, words) of each distinct name of letters; a name's words are joined by blanks."""

    def cut(batches):
        for b in batches:
            out = []
            for name in b.column(0).to_pylist():
                out += {(name, name[i:j]) for j in range(1, len(name) + 1) for i in range(max(0, j - LONGEST), j)} if len(name) <= 253 else {(name, name)}
                if len(out) > 50_000:
                    yield table("name:string word:string", out)
                    out = []
            yield table("name:string word:string", out)

    def split(batches):
        for b in batches:
            rows = [(name, " ".join(Segmenter({x["word"]: x["n"] for x in found}, total + 1)._split(name))) for name, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield table("name:string words:string", rows)

    found = names.mapInArrow(cut, "name string, word string").join(known, "word")
    # a name has at most LONGEST words for each of its letters
    each = names.join(found.groupBy("name").agg(F.collect_list(F.struct("word", "n")).alias("found")), "name", "left")
    return each.select("name", F.coalesce("found", F.array().cast("array<struct<word:string,n:bigint>>")).alias("found")).mapInArrow(split, "name string, words string")


def labelled(text: str | None, seeds: frozenset[str]) -> int:
    """1 where at least one in ``PER`` words of a page's visible text is a seed word."""
    words = LETTERS.findall(TAG.sub(" ", text).lower()) if text else []
    return int(0 < len(words) <= PER * sum(w in seeds for w in words))


def filter_urls(pages: DataFrame, key: str, url: str, html: str | None, rules=RULES, seeds: tuple[str, ...] = SEEDS, train: Column | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, log_odds and segmented host words of every row.

    ``train`` tells the rows whose labels are learned from; all if it is not given.
    """
    tuned(pages.sparkSession)
    spark = pages.sparkSession
    base = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html or url).alias("text"), F.coalesce(F.lit(True) if train is None else train, F.lit(False)).alias("train"))
    known, total = unigrams(pages, html or url, seeds)
    bad = frozenset(seeds)

    def hosts_of(batches):
        for b in batches:
            rows = zip(*(c.to_pylist() for c in b.columns), strict=True)
            yield table("page_id:long url:string at:string label:int", [(k, u, parts(u)[0], labelled(t, bad) if learn else None) for k, u, t, learn in rows])

    def names_of(batches):
        for b in batches:
            yield table("at:string i:int name:string", [(h, i, x) for h in b.column(0).to_pylist() for i, x in enumerate(LETTERS.findall(h))])

    of_page = written(base.mapInArrow(hosts_of, "page_id bigint, url string, at string, label int"), "urls")
    names = written(of_page.select("at").distinct().mapInArrow(names_of, "at string, i int, name string"), "names")
    split = written(segmented(names.select("name").distinct(), known, total), "segmented")
    of_host = names.join(split, "name").groupBy("at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "words"))), lambda x: x["words"]), " ").alias("words"))
    base = written(of_page.join(of_host, "at", "left").select("page_id", "url", F.coalesce("words", F.lit("")).alias("words"), "label"), "host-words")
    for one in (known, of_page, names, split):
        forget(one)
    counted = "label:int bucket:int n:long"

    def count(batches):
        seen = np.zeros((2, BUCKETS + 1), np.int64)
        for b in batches:
            for _, u, of_host, label in zip(*(c.to_pylist() for c in b.columns), strict=True):
                of_host, of_path = of_host.split(), path_tokens(parts(u)[1])
                seen[label, BUCKETS] += 1
                for kind, tokens in (("h", of_host), ("p", of_path)):
                    for t in tokens:
                        seen[label, bucket(kind, t)] += 1
        at = np.argwhere(seen)
        yield table(counted, [(int(a), int(c), int(seen[a, c])) for a, c in at])

    counts = np.zeros((2, BUCKETS + 1), np.float64)
    for r in base.where("label is not null").mapInArrow(count, ddl(counted)).groupBy("label", "bucket").agg(F.sum("n").alias("n")).collect():
        counts[r.label, r.bucket] = r.n
    used = max(1, int((counts[:, :BUCKETS].sum(0) > 0).sum()))
    each = np.log(counts[:, :BUCKETS] + 1.0) - np.log(counts[:, :BUCKETS].sum(1, keepdims=True) + used)
    prior = math.log((counts[1, BUCKETS] + 1.0) / (counts[0, BUCKETS] + 2.0))
    odds = spark.sparkContext.broadcast((each[1] - each[0]).astype(np.float64))

    def score(batches):
        table_of = odds.value
        for b in batches:
            rows = []
            for k, u, of_host, _ in zip(*(c.to_pylist() for c in b.columns), strict=True):
                host, path = parts(u)
                rule, verdict = ruled(host, path, rules)
                of_host, of_path = of_host.split(), path_tokens(path)
                x = prior + sum(table_of[bucket("h", t)] for t in of_host) + sum(table_of[bucket("p", t)] for t in of_path)
                rows.append((k, host, path, rule, verdict or ("block" if x > 0 else "allow"), float(x), " ".join(of_host)))
            yield table(SCORED, rows)

    return base.mapInArrow(score, ddl(SCORED))


def op2(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "url", "html")
