"""URL filter: host word segmentation, then multinomial naive Bayes; explicit rules come first.

A unigram model (words by the number of distinct hosts whose URLs have them, over all rows)
splits letters into words by Viterbi search, so that names run together score like their words.
Words are counted where they stand alone: in paths, and in host labels that have delimiters; so a
name run together is no word for being a host of the very table. Naive Bayes, trained on the
labelled URLs below, then scores the words of host and path. A rule that fits the host or one
of its parents, and a prefix of the path, decides before the model does; the longest such rule wins.

No word is left out for its rank or length: one is known from MIN_HOSTS hosts on. Up to
LEXICON_WORDS words are broadcast; more are joined, by shuffle, with the substrings of the
different letter runs, which gives the same.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule
and gets the model's verdict on no words (allow); repeated and null ids keep a row each; a
label of any length is split in time linear in it; extra columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.llm.common import map_arrow, table
from voxlake.session import cut

#: Rules (verdict, host, path prefix) of the registered query; fixed values.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]

#: Labelled training URLs without their scheme.
BLOCK_URLS = """
m.discount-pills.shop/buy  pills-online.info/order  www.casino-royal.bet/slots  mega-casino.net/bonus  win-big.bet/jackpot
lucky-win.com/slots  sports-bets.net/odds  live-bets.bet/win  free-spins.com/bonus  get-free-stuff.biz/win
spam-links.org/seo  bulk-spam.biz/email  link-farm.biz/links  content-farm.info/seo  blog.adult-video.com/porn
adult-dating.net/chat  www.adult-cams.info/live  xxx-tube.com/porn  blog.porn-clips.net/sex  m.sex-chat.info/adult
popup-ads.com/click  banner-ads.net/pixel  ads-network.biz/click  click-track.biz/pixel  user-track.net/ads  viagra-store.net/cheap
buy-cheap-meds.com/pills  cheap-watches.shop/replica  pokies-jackpot.com/casino  slots-bonus.bet/casino  payday-loan-fast.com/cash
fast-cash-loans.biz/payday  blog.replica-bags.shop/cheap  crypto-giveaway.win/free  hot-singles.info/adult  poker-bonus.com/bet
torrent-warez.net/crack  keygen-crack.org/warez  malware-download.biz/free  phish-login.info/verify  weight-loss-miracle.biz/pills
""".split()
ALLOW_URLS = """
www.city-library.org/catalog  news.daily-times.com/world  blog.open-science.org/article  en.public-encyclopedia.org/wiki
docs.python-guide.org/tutorial  university.edu/research  museum-history.org/collection  recipes.home-kitchen.com/bread
weather-service.gov/forecast  www.school-lessons.net/math  garden-club.org/plants  health-clinic.org/advice
travel-notes.com/guide  music-theory.net/lessons  film-review.com/drama  forum.linux-users.org/help  m.sports-news.com/football
shop.book-store.com/novel  archive.letters.org/poems  blog.family-kitchen.net/soup  www.art-gallery.org/paintings
code-review.dev/patterns  www.state-parks.gov/trails  journal-medicine.org/study  language-learn.net/grammar
economics-today.com/markets  www.county-records.gov/deeds  birds-watch.org/field  blog.web-design.net/css  www.math-notes.edu/proof
dairy-farm.org/milk  race-track.com/results  m.train-times.net/timetable  blog.old-maps.org/atlas  www.river-trust.org/fish
free-library.org/books  adult-education.edu/courses  live-radio.net/music  news.space-center.gov/launch  m.local-events.com/calendar
""".split()

#: Added to the log odds of block: where words say little, a page is allowed.
BIAS = -0.5
#: A word is known if the URLs of so many hosts have it, or a training URL.
MIN_HOSTS = 2
#: Words that are broadcast (under 60 MB in a worker); more are joined by shuffle.
LEXICON_WORDS = 300_000
#: Distinct hosts that a word of the training URLs counts for, besides those that have it.
SEED_COUNT = 20
#: Letter runs whose log odds a worker keeps, and the longest of them.
MEMO, MEMO_LETTERS = 200_000, 64
#: Runs of a larger share of all are joined by broadcast: at most as many as that allows.
HOT_SHARE = 1e-4

_LETTERS = re.compile(r"[a-z]+")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path: after the first ``://`` up to ``/ ? #`` or the end; then up to ``? #`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_name(host: str, path: str) -> str:
    return host + path


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as a string, and its verdict; both null if none fits."""
    name = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(rule_name(*r[1:])), r[1:])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, rule_name(h, p)).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def _runs_of(text: Column) -> Column:
    return F.filter(F.split(text, "[^a-z]+"), lambda w: w != "")


def host_word_counts(urls: DataFrame) -> DataFrame:
    """(word, n): distinct hosts whose URLs have the word on its own, over all rows; partial sums come before the shuffles."""
    delimited = F.filter(F.split("host", r"\."), lambda x: F.size(_runs_of(x)) > 1)
    words = F.explode(F.concat(F.flatten(F.transform(delimited, _runs_of)), _runs_of(F.lower("path"))))
    return urls.select("host", words.alias("word")).distinct().groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_HOSTS)


def runs_of_url(host: str, path: str) -> list[str]:
    """Letter runs of host (without its top-level name, which says nothing of the site) and path."""
    return _LETTERS.findall(host.rpartition(".")[0] or host) + _LETTERS.findall(path.lower())


@dataclass
class UrlModel:
    """Unigram scores and naive Bayes weights; see the module."""

    counts: dict[str, int]
    total: int = 0
    weights: dict[str, float] = field(default_factory=dict)
    prior: float = 0.0
    removed: frozenset[str] = frozenset()

    def __post_init__(self) -> None:
        self.total = self.total or sum(self.counts.values()) or 1
        self.score = {w: math.log(n / self.total) for w, n in self.counts.items()}
        self.lengths = sorted({len(w) for w in self.counts})
        self.memo: dict[str, float] = {}

    @classmethod
    def fit(cls, counts: dict[str, int], total: int, block: list[str], allow: list[str]) -> UrlModel:
        """From the counts of words that occur in the training URLs, and the sum of all words' counts."""
        merged = Counter(counts)
        seeds = [w for url in [*block, *allow] for w in _LETTERS.findall(url)]
        for w in seeds:
            merged[w] += SEED_COUNT
        total += SEED_COUNT * len(seeds)
        # a training name that is itself words run together is no word
        removed = set()
        for url in [*block, *allow]:
            for label in _LETTERS.findall(url.split("/")[0]):
                parts = cls({w: n for w, n in merged.items() if w != label}, total).segment(label)
                if len(parts) > 1 and all(p in merged and len(p) > 2 for p in parts):
                    merged.pop(label, None)
                    removed.add(label)
        model = cls(dict(merged), total)
        seen = [Counter(w for u in urls for run in runs_of_url(*_split(u)) for w in model.segment(run)) for urls in (block, allow)]
        known = {*seen[0], *seen[1]}
        size = [sum(s.values()) + len(known) for s in seen]
        weights = {w: math.log((seen[0][w] + 1) / size[0]) - math.log((seen[1][w] + 1) / size[1]) for w in known}
        return cls(dict(merged), total, weights, math.log(len(block) / len(allow)) + BIAS, frozenset(removed))

    def segment(self, text: str) -> list[str]:
        """The most likely split of letters into words (Viterbi); unknown words lose a factor of ten a letter."""
        n, begin, more = len(text), math.log(10 / self.total), -math.log(10)
        best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
        loose, loose_from = -math.inf, 0  # the best split that ends in an unknown word here, and where that begins
        for end in range(1, n + 1):
            if best[end - 1] + begin >= loose:
                loose, loose_from = best[end - 1] + begin, end - 1
            loose += more
            best[end], back[end] = loose, loose_from
            for length in self.lengths:
                if length > end:
                    break
                s = self.score.get(text[end - length : end])
                if s is not None and best[end - length] + s >= best[end]:
                    best[end], back[end] = best[end - length] + s, end - length
        out, end = [], n
        while end:
            out.append(text[back[end] : end])
            end = back[end]
        return out[::-1]

    def run_odds(self, run: str) -> float:
        """Log odds of a letter run's words; words that training has not seen count for neither side."""
        found = self.memo.get(run)
        if found is None:
            found = sum(self.weights.get(w, 0.0) for w in self.segment(run))
            if len(self.memo) < MEMO and len(run) <= MEMO_LETTERS:
                self.memo[run] = found
        return found

    def log_odds(self, host: str, path: str) -> float:
        """Log odds of block."""
        return self.prior + sum(map(self.run_odds, runs_of_url(host, path)))


def _split(url: str) -> tuple[str, str]:
    host, _, path = url.partition("/")
    return host, "/" + path


def _odds_by_join(urls: DataFrame, lexicon: DataFrame, model: UrlModel) -> DataFrame:
    """(n, odds): the sum of the log odds of each URL's letter runs, with the lexicon joined by shuffle."""
    spark = urls.sparkSession
    seeds = spark.createDataFrame([*model.counts.items()], "word string, n long")
    words = cut(lexicon.where(~F.col("word").isin(*model.removed)).join(seeds.select("word"), "word", "left_anti").unionByName(seeds))
    longest = words.agg(F.max(F.length("word"))).first()[0]
    # as runs_of_url
    host = F.when(F.instr("host", ".") > 0, F.expr("substring(host, 1, length(host) - instr(reverse(host), '.'))")).otherwise(F.col("host"))
    host = F.when(host == "", F.col("host")).otherwise(host)
    occurs = cut(urls.select("n", F.explode(F.concat(_runs_of(host), _runs_of(F.lower("path")))).alias("run")))
    counted = cut(occurs.groupBy("run").agg(F.count(F.lit(1)).alias("times")))
    cuts = counted.select("run", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("at"))
    sizes = F.sequence(F.lit(1), F.least(F.lit(longest), F.length("run") - F.col("at") + 1))
    pieces = cuts.select("run", F.explode(F.transform(sizes, lambda k: F.substring("run", F.col("at"), k))).alias("piece")).distinct()
    found = pieces.join(words, F.col("piece") == F.col("word")).groupBy("run").agg(F.collect_list(F.struct("word", words["n"])).alias("known"))
    total, weights = model.total, model.weights

    def each(batch: pa.RecordBatch):
        odds = []
        for run, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = UrlModel({k["word"]: k["n"] for k in known}, total)
            odds.append(sum(weights.get(w, 0.0) for w in own.segment(run)))
        yield table({"run": (batch.column(0), None), "odds": (odds, pa.float64())})

    scored = cut(map_arrow(found, each, "run string, odds double").where("odds <> 0").join(counted, "run").select(F.col("run").alias("of_run"), "odds", "times"))
    least = HOT_SHARE * (counted.agg(F.sum("times")).first()[0] or 0)
    right = [scored.where(F.col("times") > least), scored.where(F.col("times") <= least)]
    hot = occurs.join(F.broadcast(right[0]), F.col("run") == F.col("of_run"), "left")
    parts = [hot.where(F.col("of_run").isNotNull()).select("n", "odds"), hot.where(F.col("of_run").isNull()).select("n", "run").join(right[1], F.col("run") == F.col("of_run")).select("n", "odds")]
    return parts[0].unionByName(parts[1]).groupBy("n").agg(F.sum("odds").alias("odds"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], id_column: str = "page_id", url_column: str = "url", block: list[str] = BLOCK_URLS, allow: list[str] = ALLOW_URLS) -> DataFrame:
    """(id, host, path, rule, verdict, block_log_odds) of every row."""
    spark = pages.sparkSession
    host, path = url_parts(F.col(url_column))
    urls = pages.select(F.col(id_column).alias("id"), host.alias("host"), path.alias("path"))
    lexicon = cut(host_word_counts(urls))
    size = lexicon.agg(F.count(F.lit(1)).alias("words"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    letters = [run for u in [*block, *allow] for run in _LETTERS.findall(u)]
    inside = spark.createDataFrame([(w,) for w in {r[i:j] for r in letters for i in range(len(r)) for j in range(i + 1, len(r) + 1)}], "w string")
    own = {r["word"]: r["n"] for r in lexicon.join(F.broadcast(inside), F.col("word") == F.col("w"), "left_semi").collect()}
    model = UrlModel.fit(own, size["total"], block, allow)
    rule, ruled = matching_rule(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce("ruled", F.when(F.col("block_log_odds") > 0, "block").otherwise("allow"))
    out = [F.col("id").alias(id_column), "host", "path", "rule", verdict.alias("verdict"), "block_log_odds"]
    if size["words"] > LEXICON_WORDS:
        numbered = cut(urls.withColumn("n", F.monotonically_increasing_id()))
        odds = _odds_by_join(numbered, lexicon, model).withColumnRenamed("n", "of_n")
        scored = numbered.select("*", rule.alias("rule"), ruled.alias("ruled")).join(odds, F.col("n") == F.col("of_n"), "left")
        return scored.withColumn("block_log_odds", F.lit(model.prior) + F.coalesce("odds", F.lit(0.0))).select(out)
    counts = {r["word"]: r["n"] for r in lexicon.collect() if r["word"] not in model.removed} | model.counts
    parts = spark.sparkContext.broadcast((counts, model.total, model.weights, model.prior))
    ready = urls.select("id", "host", "path", rule.alias("rule"), ruled.alias("ruled"))
    kind = ready.schema["id"].dataType.simpleString()
    held: list[UrlModel] = []

    def each(batch: pa.RecordBatch):
        if not held:
            held.append(UrlModel(*parts.value))
        odds = [held[0].log_odds(h, p) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield table({n: (batch.column(i), None) for i, n in enumerate(batch.schema.names)} | {"block_log_odds": (odds, pa.float64())})

    return map_arrow(ready, each, f"id {kind}, host string, path string, rule string, ruled string, block_log_odds double").select(out)
