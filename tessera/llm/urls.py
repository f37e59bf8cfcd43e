"""URL filters: rules by host and path, and gradient-boosted trees on lexical features where no rule fits.

The trees learn from labelled URLs. `labelled()` makes them from what is known of a table: the verdict of a rule where
one fits, else block where a part of the host is a word of CUES, else allow as background (most URLs of a crawl are
harmless, and those that aren't look like the labelled ones). Own labels can be given instead. Of all distinct URLs of
up to TRAIN_LENGTH characters the TRAIN_ROWS first by hash are learned from: that bound is the only sample here.
Counts of suffixes are of all URLs, and every URL is scored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read, small_batches, texts
from .toxicity import Trees

TRAIN_ROWS, TRAIN_LENGTH = 20_000, 2_048
#: Suffixes of at least one in so many URLs have figures of their own (fewer than that many), the others share one.
COMMON = 1_000
#: Labelled URLs that a suffix counts in addition, at the share of all.
PRIOR = 20
#: Words of hosts that sell bets, pills, adult content, clicks or copies of other sites.
CUES = frozenset("adult bet bets casino cheap clickbait escort farm gambling jackpot lottery malware phish pills poker porn replica sex slots spam track tracker viagra warez xxx".split())
FEATURES = (
    "length", "host_length", "path_length", "host_depth", "path_depth", "digits", "host_digits", "host_hyphens", "host_entropy", "entropy", "params", "query_length", "fragment",
    "secure", "longest_label", "vowels", "escapes", "marks", "suffix_share", "suffix_blocked", "file_share", "file_blocked",
)
VOWELS = np.frombuffer(b"aeiouy", np.uint8)
PART = re.compile(r"[.\-_0-9]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Rule:
    """Fits its host and all subdomains, where the path starts with the rule's."""

    action: str
    host: str
    path: str

    def __str__(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def split(url: str) -> tuple[str, str, str, str]:
    """(scheme, host, path, rest): the host stands between the first `://` and `/`, `?`, `#` or the end; without `://`, all are empty."""
    at = url.find("://")
    if at < 0:
        return "", "", "", ""
    host_end = min((k for k in (url.find(c, at + 3) for c in "/?#") if k >= 0), default=len(url))
    path_end = min((k for k in (url.find(c, host_end) for c in "?#") if k >= 0), default=len(url))
    return url[:at], url[at + 3 : host_end].translate(LOWER), url[host_end:path_end], url[path_end:]


class Rules:
    """The longest rule of a host and path; each length of a rule's host is looked up once, however long the URL is."""

    def __init__(self, rules: Sequence[Rule]):
        self.by_host: dict[str, list[Rule]] = {}
        for rule in rules:
            self.by_host.setdefault(rule.host, []).append(rule)
        self.lengths = sorted({len(h) for h in self.by_host})

    def find(self, host: str, path: str) -> Rule | None:
        best = None
        for k in self.lengths:
            if k and (len(host) == k or len(host) > k and host[-k - 1] == "."):
                for rule in self.by_host.get(host[-k:], ()):
                    if path.startswith(rule.path) and (best is None or (len(str(rule)), len(rule.host)) > (len(str(best)), len(best.host))):
                        best = rule
        return best


def suffixes(host: str, path: str) -> tuple[str, str]:
    """The last label of the host, and what follows the last dot of the path's last part; cut to 16 characters."""
    name = path[path.rfind("/") + 1 :]
    return host[host.rfind(".") + 1 :][:16], name[name.rfind(".") + 1 :][:16] if "." in name else ""


def _entropy(counts: np.ndarray) -> float:
    p = counts[counts > 0] / max(1, counts.sum())
    return float(-(p * np.log2(p)).sum())


def _bytes(text: str) -> np.ndarray:
    return np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)


@dataclass
class Suffixes:
    """(log share of URLs, share of labelled ones that are blocked) by suffix; those without figures share OTHER."""

    host: dict[str, tuple[float, float]] = field(default_factory=dict)
    file: dict[str, tuple[float, float]] = field(default_factory=dict)
    OTHER = None

    def of(self, host: str, path: str) -> tuple[float, float, float, float]:
        a, b = suffixes(host, path)
        none = (math.log(0.5 / COMMON), 0.5)
        return (*self.host.get(a, self.host.get(self.OTHER, none)), *self.file.get(b, self.file.get(self.OTHER, none)))


def features(url: str, stats: Suffixes) -> list[float]:
    scheme, host, path, rest = split(url)
    whole, own = _bytes(url), _bytes(host)
    letters = max(1, int(own[97:123].sum()))
    query = rest[1:].split("#", 1)[0] if rest.startswith("?") else ""
    n = max(1, len(url))
    marks = int(whole[33:48].sum() + whole[58:65].sum() + whole[91:97].sum() + whole[123:127].sum())
    return [
        math.log1p(len(url)), math.log1p(len(host)), math.log1p(len(path)), math.log1p(host.count(".")), math.log1p(path.count("/")), int(whole[48:58].sum()) / n, int(own[48:58].sum()) / max(1, len(host)),
        math.log1p(int(own[45])), _entropy(own), _entropy(whole), math.log1p(query.count("&") + bool(query)), math.log1p(len(query)), float("#" in rest),
        float(scheme.translate(LOWER) == "https"), math.log1p(max(map(len, host.split(".")))), int(own[VOWELS].sum()) / letters, int(whole[37]) / n, marks / n, *stats.of(host, path),
    ]


@dataclass
class Model:
    stats: Suffixes
    trees: Trees | None

    def score(self, urls: list[str]) -> np.ndarray:
        """How likely each is to be blocked; 0 without trees."""
        if self.trees is None or not urls:
            return np.zeros(len(urls))
        return 1 / (1 + np.exp(-self.trees.margin(np.array([features(u, self.stats) for u in urls]))))


def cued(host: str) -> bool:
    return any(p in CUES for p in PART.split(host))


def label(url: str, rules: Rules) -> int:
    """1 (block) or 0 (allow): the rule's verdict, else whether the host holds a cue."""
    _, host, path, _ = split(url)
    rule = rules.find(host, path)
    return int(rule.action == "block") if rule else int(cued(host))


def labelled(urls: DataFrame, rules: Sequence[Rule], rows: int = TRAIN_ROWS) -> list[tuple[str, int]]:
    """(url, label) of the first rows distinct URLs by hash, at most rows x TRAIN_LENGTH characters."""
    short = urls.where(F.col("url").isNotNull() & (F.length("url") <= TRAIN_LENGTH)).select("url").distinct()
    chosen = short.orderBy(F.xxhash64("url"), "url").limit(rows).collect()
    own = Rules(rules)
    return [(r["url"], label(r["url"], own)) for r in chosen]


def _suffix_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, suffix, n) of a partition; what a task holds of it is handed on where it grows long."""
    seen: Counter[tuple[str, str]] = Counter()

    def flush() -> pa.RecordBatch:
        keys = list(seen)
        out = pa.record_batch([pa.array([k for k, _ in keys], pa.string()), pa.array([s for _, s in keys], pa.string()), pa.array([seen[k] for k in keys], pa.int64())], names=["kind", "suffix", "n"])
        seen.clear()
        return out

    for batch in batches:
        for url in texts(batch.column(0)):
            _, host, path, _ = split(url)
            a, b = suffixes(host, path)
            seen["host", a] += 1
            seen["file", b] += 1
        if len(seen) > 100_000:
            yield flush()
    yield flush()


def suffix_figures(urls: DataFrame, known: Sequence[tuple[str, int]]) -> Suffixes:
    """Counted over all URLs. What comes to the driver: suffixes of at least one in COMMON of the URLs, of two kinds."""
    counts = urls.select("url").mapInArrow(_suffix_counts, "kind string, suffix string, n long").groupBy("kind", "suffix").agg(F.sum("n").alias("n"))
    total = urls.count()
    common = counts.where(F.col("n") * COMMON >= max(1, total)).collect()
    blocked: dict[tuple[str, str], list[int]] = {}
    for url, y in known:
        _, host, path, _ = split(url)
        for key in zip(("host", "file"), suffixes(host, path), strict=True):
            blocked.setdefault(key, []).append(y)
    share = sum(y for _, y in known) / max(1, len(known))
    out = Suffixes()
    for kind, table in (("host", out.host), ("file", out.file)):
        for r in common:
            if r["kind"] == kind:
                ys = blocked.pop((kind, r["suffix"]), [])
                table[r["suffix"]] = (math.log(r["n"] / total), (sum(ys) + PRIOR * share) / (len(ys) + PRIOR))
        rest = [y for (k, _), ys in blocked.items() if k == kind for y in ys]
        left = max(0, total - sum(r["n"] for r in common if r["kind"] == kind))
        table[Suffixes.OTHER] = (math.log((left + 0.5) / (total + 1) / COMMON), (sum(rest) + PRIOR * share) / (len(rest) + PRIOR))
    return out


def fit(known: Sequence[tuple[str, int]], stats: Suffixes) -> Model:
    """Trees over labelled URLs, sorted first: the order in which they come plays no part. Without both labels there are none."""
    y = np.array([float(v) for _, v in known])
    if not 0 < y.sum() < len(y):
        return Model(stats, None)
    x = np.array([features(u, stats) for u, _ in known])
    order = np.lexsort([*x.T, y])
    return Model(stats, Trees().fit(x[order], y[order]))


def train(urls: DataFrame, rules: Sequence[Rule] = RULES, known: Sequence[tuple[str, int]] | None = None, rows: int = TRAIN_ROWS) -> Model:
    """A model from urls (url) and known labels, which default to labelled(urls, rules)."""
    small_batches(urls.sparkSession)
    known = labelled(urls, rules, rows) if known is None else list(known)[:rows]
    return fit(known, suffix_figures(urls, known))


def _judged(batches: Iterator[pa.RecordBatch], model: Model, rules: Rules, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        urls = texts(batch.column(0))
        parts = [split(u) for u in urls]
        found = [rules.find(host, path) for _, host, path, _ in parts]
        open_ = [i for i, rule in enumerate(found) if rule is None]
        score: list[float | None] = [None] * len(urls)
        for i, s in zip(open_, model.score([urls[i] for i in open_]).tolist(), strict=True):
            score[i] = s
        verdict = [rule.action if rule else "block" if score[i] >= threshold else "allow" for i, rule in enumerate(found)]
        yield pa.record_batch(
            [*(batch.column(i) for i in range(1, batch.num_columns)), pa.array([p[1] for p in parts], pa.string()), pa.array([p[2] for p in parts], pa.string()),
             pa.array([str(r) if r else None for r in found], pa.string()), pa.array(score, pa.float64()), pa.array(verdict, pa.string())],
            names=[*batch.schema.names[1:], "host", "path", "rule", "score", "verdict"],
        )


def judged(df: DataFrame, model: Model, rules: Sequence[Rule] = RULES, threshold: float = 0.5, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """keep, host, path, rule, score (null where a rule decides) and verdict of each row's url. No shuffle; the model is a few hundred KB."""
    small_batches(df.sparkSession)
    url: Column = F.col("url").cast("string").alias("_tessera_url")
    chosen = df.select(url, *[F.col(f"`{c}`") for c in keep])
    own = Rules(rules)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[1:])
    return chosen.mapInArrow(lambda b: _judged(b, model, own, threshold), f"{kinds}, host string, path string, rule string, score double, verdict string")


def op13_urls(spark, sf_dir: str) -> DataFrame:
    """A row for each page. A null url counts as an empty one: host and path are empty, no rule fits, and the trees judge it.

    Repeated rows are rows like others. Of rules of one length the one of the longer host wins. Other columns, among
    them html, play no part and are not read. An empty table gives an empty result.
    """
    pages = read(spark, sf_dir, "pages")
    return judged(pages, train(pages.select(F.col("url").cast("string").alias("url"))))
