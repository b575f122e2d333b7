"""URL filter: rules by host and path, and for all other addresses naive Bayes over segmented names.

Names such as ``cheapflightstoday`` are split by the most probable sequence of known words (Viterbi over unigram
probabilities counted in the text of all pages). The tokens of host and path feed a multinomial naive Bayes model. It
learns from the addresses that the rules decide, and from a short list of seed words that count for blocking from the
start, as if some blocked addresses held them, until the allowed addresses with them outweigh that.

Word and token counts cover all pages and are added up before the shuffle. They stay tables, whatever their number: each
distinct letter run of the addresses is joined to the words that stand in it and split on its own, its tokens are joined
to their weights, and pages are judged in blocks of rows with the weights of the block's distinct runs, so that a common
host or run counts once per block. Nothing that grows is broadcast or collected. Classes weigh the same at the start, since the rules do not say how many of the other addresses are bad. Words of the rules
themselves (``org``, ``de``) only tell that a rule decided, so the model leaves them out; and it blocks an address only
at odds of ``MIN_ODDS`` to one, so that what no known word speaks against is allowed.

Defined results: a null address, or one without ``://``, has an empty host and path, fits no rule and is allowed unless
the model objects to an empty name; repeated pages are judged each; without rules or pages the seed words alone decide.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.llm.words import arrow_rows
from wardlake.session import materialize

ALLOW, BLOCK = "allow", "block"
Rule = tuple[str, str]

# Rule (host, path prefix) and its verdict.
RULES: tuple[Rule, ...] = (
    ("org/", ALLOW),
    ("example.org/es/", BLOCK),
    ("example.org/en/1", BLOCK),
    ("com/fr/", ALLOW),
    ("com/de/", BLOCK),
)

# Words that count for blocking from the start.
SEEDS = ("adult", "bet", "betting", "bonus", "casino", "cheap", "clickbait", "farm", "gamble", "hack", "malware", "pharma")
SEEDS += ("phishing", "pills", "poker", "porn", "replica", "scam", "sex", "slots", "spam", "viagra", "warez", "xxx")
# How likely a seed word is as a token of a blocked or an allowed address, before any is counted.
SEED_SHARE = {BLOCK: 1e-2, ALLOW: 1e-4}

MIN_WORD, MAX_WORD = 2, 24
SMOOTHING = 1.0
# An address is blocked if it is so many times likelier as a blocked one.
MIN_ODDS = 10.0
NUMBER = "<number>"
# Pages judged at once, as a power of two, and candidates for words handed on at once.
BLOCK_BITS = 12
PARTS_AT_ONCE = 50_000

_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of an address."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


class RuleBook:
    """Rules by host; a rule holds for its host and all below it, for paths that start with its path."""

    def __init__(self, rules: Sequence[Rule]) -> None:
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for rule, verdict in sorted(rules, key=lambda r: -len(r[0])):
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host, []).append((slash + path, rule, verdict))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest rule that fits, and its verdict."""
        best = None
        while host:
            for start, rule, verdict in self.by_host.get(host, ()):
                if path.startswith(start) and (best is None or len(rule) > len(best[0])):
                    best = rule, verdict
            host = host.partition(".")[2]
        return best


class Segmenter:
    """Splits a run of letters into its most probable words."""

    def __init__(self, counts: dict[str, int], total: int | None = None) -> None:
        total = total or sum(counts.values()) or 1
        self.cost = {w: -math.log(n / total) for w, n in counts.items()}
        self.longest = max(map(len, counts), default=1)
        # an unknown word gets less likely tenfold with every letter
        self.unknown, self.letter = math.log(total) + math.log(10), math.log(10)
        self.known: dict[str, list[str]] = {}

    def __call__(self, name: str) -> list[str]:
        found = self.known.get(name)
        if found is None:
            found = self._split(name)
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[name] = found
        return found

    def _split(self, name: str) -> list[str]:
        n = len(name)
        best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
        # an unknown stretch may be of any length: the cheapest way to have opened one so far
        opened, opened_at = math.inf, 0
        for end in range(1, n + 1):
            start = best[end - 1] + self.unknown
            if start < opened:
                opened, opened_at = start, end - 1
            opened += self.letter
            best[end], back[end] = opened, opened_at
            for at in range(max(0, end - self.longest), end):
                cost = self.cost.get(name[at:end])
                if cost is not None and best[at] + cost < best[end]:
                    best[end], back[end] = best[at] + cost, at
        words, end = [], n
        while end:
            words.append(name[back[end] : end])
            end = back[end]
        return words[::-1]


def marked_runs(host: str, path: str) -> list[str]:
    """Letter runs of host (``h:``) and path (``p:``) with their marks; every number is the same run."""
    parts = [(mark, part) for mark, text in (("h:", host), ("p:", path.lower())) for part in _TOKEN.findall(text)]
    return [mark + (NUMBER if part[0].isdigit() else part) for mark, part in parts]


def tokens_of(run: str, segment: Segmenter) -> list[str]:
    """Words of a marked run, each with its mark."""
    return [run] if run[2:] == NUMBER else [run[:2] + w for w in segment(run[2:])]


def word_counts(pages: DataFrame, html: str = "html") -> DataFrame:
    """(word, n) over the visible text of all pages."""
    text = F.regexp_replace(F.col(html), r"(?is)<(script|style)\b.*?</\1>|<[^>]*>|&[a-z#0-9]+;", " ")
    words = F.explode(F.split(F.lower(text), r"[^\p{L}]+")).alias("word")
    long = F.length("word").between(MIN_WORD, MAX_WORD)
    return pages.select(words).where(long).groupBy("word").agg(F.count("*").alias("n"))


def _placed(pages: DataFrame) -> DataFrame:
    """page_id, url and the block of ``1 << BLOCK_BITS`` rows at most, written once so that blocks stay as they are."""
    block = F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS).alias("block")
    return materialize(pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", block), "url-blocks")


def _uses(placed: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(block, run, n, blocked): marked runs of each block, and how often rules decide or block an address with them."""
    book = RuleBook(rules)
    schema = pa.schema([("block", pa.int64()), ("run", pa.string()), ("n", pa.int64()), ("blocked", pa.int64())])

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict]:
        for batch in batches:
            found: dict[tuple[int, str], list[int]] = {}
            for block, raw in zip(batch["block"], batch["url"]):
                host, path = split_url(raw and raw.decode())
                rule = book.find(host, path)
                for name in marked_runs(host, path):
                    counts = found.setdefault((block, name), [0, 0])
                    counts[0] += rule is not None
                    counts[1] += rule is not None and rule[1] == BLOCK
            columns = ([k[0] for k in found], [k[1] for k in found], [n for n, _ in found.values()], [b for _, b in found.values()])
            yield dict(zip(schema.names, columns))

    rows = arrow_rows(placed.select("block", "url"), run, schema, "block bigint, run string, n bigint, blocked bigint")
    return rows.groupBy("block", "run").agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked"))


def _parts(runs: DataFrame) -> DataFrame:
    """(id, word): everything in a run that may be a word, some more than once if the run is very long."""
    schema = pa.schema([("id", pa.int64()), ("word", pa.string())])

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict]:
        for batch in batches:
            ids: list[int] = []
            words: list[str] = []
            for at, raw in zip(batch["id"], batch["run"]):
                name = raw.decode()[2:]
                found: set[str] = set()
                for i in range(len(name) if name != NUMBER else 0):
                    found.update(name[i:j] for j in range(i + MIN_WORD, min(i + MAX_WORD, len(name)) + 1))
                    if len(found) > PARTS_AT_ONCE:
                        yield {"id": [at] * len(found), "word": list(found)}
                        found = set()
                ids += [at] * len(found)
                words += found
                if len(words) > PARTS_AT_ONCE:
                    yield {"id": ids, "word": words}
                    ids, words = [], []
            yield {"id": ids, "word": words}

    return arrow_rows(runs.select("id", "run"), run, schema, "id bigint, word string")


def _segmented(runs: DataFrame, words: DataFrame) -> DataFrame:
    """``runs`` with the ``tokens`` of each, split by the counts of all words that stand in it."""
    total = words.agg(F.sum("n")).first()[0] or 0
    # seed words count as ordinary words of the language
    counted = {r.word: r.n for r in words.where(F.col("word").isin(*SEEDS)).collect()}
    seeds = {w: max(counted.get(w, 0), 1 + total // 100_000) for w in SEEDS}
    total += sum(seeds.values()) - sum(counted.values())
    known = _parts(runs).join(words, "word").groupBy("id").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    schema = pa.schema([("id", pa.int64()), ("tokens", pa.list_(pa.string()))])

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict]:
        for batch in batches:
            split = []
            for raw, found in zip(batch["run"], batch["known"]):
                name = raw.decode()
                counts = {r["word"]: r["n"] for r in found or ()} | {w: n for w, n in seeds.items() if w in name}
                split.append(tokens_of(name, Segmenter(counts, total)))
            yield {"id": batch["id"], "tokens": split}

    rows = runs.select("id", "run").join(known, "id", "left")
    tokens = arrow_rows(rows, run, schema, "id bigint, tokens array<string>")
    return runs.join(tokens, "id")


def log_odds(found: DataFrame, of_rules: Sequence[str]) -> DataFrame:
    """(token, weight): the logarithm of how much likelier a token is in a blocked address; 0 for all tokens not in it."""
    n_tokens, n, blocked = (x or 0 for x in found.agg(F.count("*"), F.sum("n"), F.sum("blocked")).first())
    totals = {BLOCK: blocked, ALLOW: n - blocked}

    # smoothed size of a class; without both classes nothing but the seeds' own counts is known
    known = totals[BLOCK] and totals[ALLOW]
    size = {label: total + SMOOTHING * (n_tokens + 1) if known else 1.0 for label, total in totals.items()}
    # what an unseen seed word has beyond smoothing in the blocked class, in proportion to that class's size
    prior = SMOOTHING * (SEED_SHARE[BLOCK] / SEED_SHARE[ALLOW] - 1) * max(1.0, size[BLOCK] / size[ALLOW])

    def share(n: Column, label: str) -> Column:
        return (F.coalesce(n, F.lit(0)) + SMOOTHING) / size[label]

    seeds = [(mark + word, prior) for word in SEEDS for mark in ("h:", "p:")]
    seeds = found.sparkSession.createDataFrame(seeds, "token string, prior double")
    given = F.coalesce("prior", F.lit(0.0))
    learned = F.log(share(F.col("blocked"), BLOCK) + given / size[BLOCK]) - F.log(share(F.col("n") - F.col("blocked"), ALLOW))
    weight = learned if known else F.log(1 + given / SMOOTHING)
    weights = found.join(seeds, "token", "full").select("token", weight.alias("weight"))
    return weights.where(~F.col("token").isin(*of_rules)) if of_rules else weights


def run_weights(uses: DataFrame, pages: DataFrame, rules: Sequence[Rule] = RULES, html: str = "html") -> DataFrame:
    """(run, weight) of the marked runs whose words speak for or against blocking."""
    spark = pages.sparkSession
    words = materialize(word_counts(pages, html), "url-words")
    rule_runs = [(run, 0, 0) for rule, _ in rules for run in marked_runs(*split_url(f"://{rule}"))]
    runs = uses.select("run", "n", "blocked").union(spark.createDataFrame(rule_runs, "run string, n bigint, blocked bigint"))
    runs = runs.groupBy("run").agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked"))
    runs = materialize(runs.withColumn("id", F.monotonically_increasing_id()), "url-runs")
    split = materialize(_segmented(runs, words), "url-split")
    found = split.where("n > 0").select(F.explode("tokens").alias("token"), "n", "blocked")
    found = materialize(found.groupBy("token").agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked")), "url-tokens")
    # the rules are a short fixed list
    of_rules = split.where(F.col("run").isin(*{run for run, _, _ in rule_runs})).select(F.explode("tokens")) if rule_runs else None
    weights = log_odds(found, sorted({r[0] for r in of_rules.collect()}) if rule_runs else ())
    # summed as decimals, so that the order of rows does not matter
    weight = F.sum(F.col("weight").cast("decimal(38,12)")).cast("double").alias("weight")
    by_id = split.select("id", F.explode("tokens").alias("token")).join(weights, "token").groupBy("id").agg(weight)
    return split.select("id", "run").join(by_id, "id").where("weight <> 0").select("run", "weight")


def judged(pages: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every page, and the model's ``score``, the logarithm of the odds for blocking."""
    placed = _placed(pages)
    uses = materialize(_uses(placed, rules), "url-uses")
    weights = uses.select("block", "run").join(run_weights(uses, pages, rules), "run").select("block", "run", "weight")
    book = RuleBook(rules)
    fields = [("page_id", pa.int64())]
    fields += [(name, pa.string()) for name in ("host", "path", "rule", "verdict")] + [("score", pa.float64())]
    schema = pa.schema(fields)

    def judge(block: pa.Table, known: pa.Table) -> pa.Table:
        weights = dict(zip(known["run"].to_pylist(), known["weight"].to_pylist()))
        out: dict[str, list] = {name: [] for name in schema.names}
        for page, url in zip(block["page_id"].to_pylist(), block["url"].to_pylist()):
            host, path = split_url(url)
            rule = book.find(host, path)
            score = sum(weights.get(run, 0.0) for run in marked_runs(host, path))
            verdict = rule[1] if rule else BLOCK if score >= math.log(MIN_ODDS) else ALLOW
            for column, value in zip(out.values(), (page, host, path, rule and rule[0], verdict, score)):
                column.append(value)
        return pa.Table.from_pydict(out, schema=schema)

    ddl = "page_id bigint, host string, path string, rule string, verdict string, score double"
    return placed.groupBy("block").cogroup(weights.groupBy("block")).applyInArrow(judge, ddl)
