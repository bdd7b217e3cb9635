"""URL filters: rules of hosts and paths, and for the rest the words that a URL's names are made of.

The names of a URL are the runs of letters in its host and path. Names are often words written
together, so each different name is cut into the words that are together most likely (Viterbi over
a unigram model). Candidates are the name's substrings that are words of the lexicon; they come by
a join, so the lexicon may have any size. What no word covers is a piece of its own, of a price that
grows with its length.

A multinomial naive Bayes, fitted to labelled example names, weighs the words. Only words of the
examples have a weight, so names that hold none of them drop out, and a URL's score is the sum over
what is left. Rules go before: the longest rule whose host is the URL's host or a domain above it,
and whose path begins the URL's path, decides.

The lexicon mixes three models: words of the examples (and a short list of words that are common in
URLs), whole words of a public tokenizer's vocabulary, likelier the lower their rank, and words
counted in a corpus.

Defined results: a null URL, or one without ``://``, has an empty host and path; no rule fits it
and it has no word. Of rules of one length the one that sorts last decides. Rows that repeat, and null
page_ids, are rows of their own. Extra columns are ignored. An empty table gives an empty one. Names
of any length are cut as a whole.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.plans.lineage import cut

#: Letters of the longest word of the lexicon.
WORD = 24
#: What a piece that is no word costs, and each of its letters.
OPEN, LETTER = math.log(1e-6), math.log(1 / 20)
#: Shares of the lexicon that the examples, a vocabulary and the corpus make.
SHARES = (0.2, 0.4, 0.4)
#: Added to each count of a word in a class.
SMOOTH = 0.5
#: Share of URLs that is to be blocked, before a word is seen.
PRIOR = 0.2

#: Characters of a table's keys, and 100 for each row, up to which it is broadcast instead of shuffling the URLs.
BROADCAST = 16_000_000

#: Example names of sites to block, and of sites to allow, a space between words.
BLOCK = """
casino win;online casino;casino bonus;live casino;mega casino;poker online;poker win;free poker;slots win;free slots;jackpot slots;jackpot win;free bets;sports bets;best bets;bet win;bet bonus;betting tips;
online betting;gambling win;roulette win;lottery win;cheap pills;buy pills;diet pills;cheap viagra;buy viagra;cialis online;cheap meds;pharma pills;weight loss pills;adult video;adult chat;adult dating;adult cams;adult movies;adult content;adult tube;adult x;
porn tube;free porn;porn video;sex cams;sex chat;sex video;xxx video;xxx tube;xxx porn;nude cams;escort girls;escorts;hot girls;spam farm;spam mail;link farm;link spam;seo spam;clickbait farm;ads track;ads server;ad tracker;
ad server;ad click;click track;track pixel;tracking pixel;popup ads;banner ads;adware;malware download;free warez;warez crack;crack keygen;torrent crack;payday loan;payday loans;cash loan fast;replica watches;fake watches;
get rich quick;make money fast;phishing login;counterfeit bags
"""
ALLOW = """
news daily;daily times;city news;sports news;weather report;university library;public library;free library;school district;city school;museum history;art museum;history society;science journal;medical journal;health news;
health care;hospital care;recipe kitchen;home kitchen;garden shop;book shop;online shop;online store;music store;music school;film review;book review;travel guide;city guide;city track;race track;organic farm;wind farm;
family farm;green energy;open source;free software;software docs;web docs;developer blog;family blog;travel blog;food blog;video lessons;language lessons;adult education;chat help;help center;support forum;user forum;
community forum;best practice;local business;bank online;credit union;insurance help;law office;tax office;post office;mail service;web mail;web server;photo gallery;video gallery;download center;quick start;fast train;
train times;win games;buy local;buy books;board games;chess club;football club;girls school;dating history;fashion bags;smart watches;home loans;money market;link index;image server;data center;map server
"""
#: Words that are common in URLs and say nothing.
COMMON = """
www com net org info html index home page pages example blog shop article articles archive search category tag user users post posts view static images image media content about contact en fr de es it
"""

#: Letters that are lower-cased in hosts.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_MARKUP = r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;"


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


#: The rules of the query.
RULES = (Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"), Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block"))


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """The host, with A-Z lower-cased, and the path of a URL; both empty without ``://``."""
    rest = F.expr(f"CASE WHEN instr({url}, '://') > 0 THEN substr({url}, instr({url}, '://') + 3) ELSE '' END")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.regexp_replace(rest, r"^[^/?#]*", ""), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def example_words(text: str) -> list[list[str]]:
    """The words of each example in a text that has ``;`` between examples."""
    return [name.split() for name in text.split(";")]


def weights(block: Iterable[list[str]], allow: Iterable[list[str]], smooth: float = SMOOTH) -> dict[str, float]:
    """Naive Bayes: for each word of two letters or more in the examples, the log of how much likelier it is where one blocks."""
    counts = [Counter(w for name in names for w in name if len(w) > 1) for names in (block, allow)]
    known = sorted(counts[0] | counts[1])
    sizes = [sum(c.values()) + smooth * len(known) for c in counts]
    return {w: math.log((counts[0][w] + smooth) / sizes[0]) - math.log((counts[1][w] + smooth) / sizes[1]) for w in known}


def corpus_words(pages: DataFrame, html: str = "html") -> DataFrame:
    """``word, n``: how often each word of ``WORD`` letters at most stands in the pages' texts."""
    text = F.regexp_replace(F.coalesce(F.col(html).cast("string"), F.lit("")), _MARKUP, " ")
    words = pages.select(F.explode(F.split(F.lower(text), r"[^\p{L}]+")).alias("word"))
    return words.where(f"word <> '' and length(word) <= {WORD}").groupBy("word").agg(F.count("*").alias("n"))


def vocabulary_words(path: str) -> dict[str, float]:
    """Whole words of a tokenizer's JSON vocabulary, weighed by one over the rank."""
    with open(path, encoding="utf-8") as f:
        ranks = json.load(f)["model"]["vocab"]
    return {t[:-4]: 1 / (rank + 1) for t, rank in ranks.items() if t.endswith("</w>") and t[:-4].isalpha() and len(t) - 4 <= WORD}


def lexicon(counts: DataFrame, seeds: Iterable[str], vocabulary: dict[str, float]) -> DataFrame:
    """``word, logp``: the unigram model, of ``seeds``, ``vocabulary`` (as large as a tokenizer's) and counted words by ``SHARES``."""
    fixed: Counter = Counter()
    for words, share in ((Counter(seeds), SHARES[0]), (vocabulary, SHARES[1])):
        total = sum(words.values())
        fixed.update({w: share * n / total for w, n in words.items()})
    rows = counts.sparkSession.createDataFrame(pa.table({"word": pa.array(list(fixed), pa.string()), "p": pa.array(list(fixed.values()), pa.float64())}))
    counted = cut(counts)
    every = counted.agg(F.greatest(F.sum("n"), F.lit(1)).alias("n")).scalar()
    both = counted.select("word", (SHARES[2] * F.col("n") / every).alias("p")).unionByName(rows)
    return both.groupBy("word").agg(F.log(F.sum("p")).alias("logp"))


def _key(name: str) -> str:
    return name if len(name) <= 64 else "#" + hashlib.blake2b(name.encode(), digest_size=16).hexdigest()


def _substrings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each name's key and size, and its substrings of ``WORD`` letters at most with where they begin."""
    rows: list[tuple] = []

    def batch_of() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, (pa.string(), pa.int32(), pa.int32(), pa.string()))], names=["key", "size", "start", "word"])
        rows.clear()
        return out

    for batch in batches:
        for name in batch.column(0).to_pylist():
            key, n = _key(name), len(name)
            for i in range(n):
                rows += [(key, n, i, name[i : i + k]) for k in range(1, min(WORD, n - i) + 1)]
                if len(rows) >= 20_000:
                    yield batch_of()
    yield batch_of()


class Viterbi:
    """The best way to cut one name, given its words by where they begin; holds the last ``WORD`` places only."""

    def __init__(self, key: str, size: int):
        self.key, self.size, self.at = key, size, 0
        self.cut_at: dict[int, tuple[float, tuple]] = {0: (0.0, ())}  # by place, the best score of pieces that end there
        self.inside: tuple[float, tuple] | None = None  # the best score where a piece that is no word goes on

    def _best(self) -> tuple[float, tuple]:
        known = self.cut_at.get(self.at)
        return known if self.inside is None or known is not None and known[0] >= self.inside[0] else (self.inside[0], (self.at, self.inside[1]))

    def forward(self, to: int) -> None:
        while self.at < to:
            score, link = self._best()
            opened = (score + OPEN + LETTER, link)
            on = (self.inside[0] + LETTER, self.inside[1]) if self.inside else None
            self.inside = on if on is not None and on[0] >= opened[0] else opened
            self.cut_at.pop(self.at, None)
            self.at += 1

    def word(self, start: int, size: int, logp: float) -> None:
        self.forward(start)
        score, link = self._best()
        end = start + size
        if end not in self.cut_at or score + logp > self.cut_at[end][0]:
            self.cut_at[end] = (score + logp, (end, link))

    def ends(self) -> list[int]:
        self.forward(self.size)
        link, out = self._best()[1], []
        while link:
            out.append(link[0])
            link = link[1]
        return out[::-1]


def _cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where each name's pieces end; the names' words come together, in order."""
    one = None
    for batch in batches:
        done: list[Viterbi] = []
        for key, size, start, length, logp in zip(*(c.to_pylist() for c in batch.columns)):
            if one is None or one.key != key:
                if one is not None:
                    done.append(one)
                one = Viterbi(key, size)
            one.word(start, length, logp)
        yield pa.RecordBatch.from_arrays([pa.array([v.key for v in done], pa.string()), pa.array([v.ends() for v in done], pa.list_(pa.int32()))], names=["key", "ends"])
    if one is not None:
        yield pa.RecordBatch.from_arrays([pa.array([one.key]), pa.array([one.ends()], pa.list_(pa.int32()))], names=["key", "ends"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.column(0).to_pylist()
        words = [[name[a:b] for a, b in zip([0, *ends], ends)] if ends else [name] for name, ends in zip(names, batch.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], names=["name", "words"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_key(n) for n in batch.column(0).to_pylist()], pa.string())], names=["name", "key"])


def segment(names: DataFrame, words: DataFrame) -> DataFrame:
    """``name, words``: different ``names(name)``, cut into the likeliest words of ``words(word, logp)``."""
    found = names.mapInArrow(_substrings, "key string, size int, start int, word string").join(words, "word")
    rows = found.select("key", "size", "start", F.length("word").alias("length"), "logp").repartition("key").sortWithinPartitions("key", "start", "length")
    ends = rows.mapInArrow(_cuts, "key string, ends array<int>")
    keyed = names.mapInArrow(_keys, "name string, key string").join(ends, "key", "left").select("name", "ends")
    return keyed.mapInArrow(_pieces, "name string, words array<string>")


def fitting_rules(hosts: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """``host, rules``: for each of different ``hosts(host)`` that a rule's host fits, those rules, as ``(size, rule, path, verdict)``."""
    spark, rules = hosts.sparkSession, list(rules)
    table = spark.createDataFrame([(r.host, len(r.host + r.path), r.host + r.path, r.path, r.verdict) for r in rules], "domain string, size int, rule string, path string, verdict string")
    most = max((r.host.count(".") + 1 for r in rules), default=0)
    parts = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(most))), lambda k: F.array_join(F.slice(parts, -k, k), "."))
    spread = hosts.where(F.lit(most > 0)).select("host", F.explode(above).alias("domain"))
    return spread.join(table, "domain").groupBy("host").agg(F.collect_list(F.struct("size", "rule", "path", "verdict")).alias("rules"))


def name_scores(names: DataFrame, words: DataFrame, weight: dict[str, float]) -> DataFrame:
    """``name, score``: for different ``names(name)`` that hold weighty words, the sum of their weights."""
    table = names.sparkSession.createDataFrame([(w, x) for w, x in weight.items() if x], "word string, weight double")
    used = segment(names, words).select("name", F.explode("words").alias("word"))
    return used.join(F.broadcast(table), "word").groupBy("name").agg(F.sum("weight").alias("score"))  # as many words as the examples have


def _joinable(table: DataFrame, key: str) -> DataFrame:
    """A kept table, to be broadcast if its counted size allows it."""
    kept = cut(table)
    size = kept.agg(F.coalesce(F.sum(F.length(key) + 100), F.lit(0))).first()[0]
    return F.broadcast(kept) if size <= BROADCAST else kept


def judge(pages: DataFrame, counts: DataFrame, vocabulary: str, rules: Iterable[Rule] = RULES, block: str = BLOCK, allow: str = ALLOW, prior: float = PRIOR) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of each of ``pages(page_id, url)``; ``counts(word, n)`` and the tokenizer's file ``vocabulary`` make the lexicon.

    ``score`` is the log of how much likelier it is that the URL is to be blocked, by its words alone.
    """
    examples = [example_words(block), example_words(allow)]
    words = lexicon(counts, [w for names in examples for name in names for w in name] + COMMON.split(), vocabulary_words(vocabulary))
    host, path = host_and_path()
    names = F.array_join(F.regexp_extract_all(F.lower(F.concat("host", F.lit(" "), "path")), F.lit(r"(\p{L}+)")), " ")
    urls = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path")).withColumn("names", names)
    alike = cut(urls.select("names").where("names <> ''").distinct())
    spread = alike.select("names", F.explode(F.split("names", " ")).alias("name"))
    scored = name_scores(cut(spread.select("name").distinct()), words, weights(*examples))
    scores = spread.join(scored, "name").groupBy("names").agg(F.sum("score").alias("score"))
    fitting = fitting_rules(urls.select("host").distinct(), rules)
    rows = urls.join(_joinable(fitting, "host"), "host", "left").join(_joinable(scores, "names"), "names", "left")
    rule = F.array_max(F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"])))
    score = F.coalesce("score", F.lit(0.0)) + math.log(prior / (1 - prior))
    rows = rows.select("page_id", "host", "path", rule.alias("r"), score.alias("score"))
    return rows.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "score")
