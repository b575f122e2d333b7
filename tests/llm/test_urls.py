import itertools
import math
import random

import pytest

from wardlake.llm import urls as u

PAGES = "page_id bigint, url string, html string, host string, score string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], PAGES).repartition(3)


def test_split_and_rules():
    assert u.split_url("HTTP://A.Example.ORG/en/1?x#y") == ("a.example.org", "/en/1")
    assert u.split_url("x://h?a/b") == ("h", "") and u.split_url("x://h#f") == ("h", "")
    assert u.split_url("no scheme/x") == u.split_url(None) == u.split_url("") == ("", "")
    assert u.split_url("a://b://c/d") == ("b:", "//c/d")
    book = u.RuleBook(u.RULES)
    assert book.find("example.org", "/es/") == ("example.org/es/", "block")
    assert book.find("www.example.org", "/en/12") == ("example.org/en/1", "block")
    assert book.find("myexample.org", "/es/") == ("org/", "allow")
    assert book.find("org", "/") == ("org/", "allow") and book.find("org", "") is None
    assert book.find("a.com", "/fr/x")[1] == "allow" and book.find("a.com", "/de/")[1] == "block"
    assert book.find("a.comx", "/de/") is None and book.find("", "/de/") is None


def test_segmentation_is_the_most_probable_one():
    counts = {"cheap": 50, "che": 9, "ap": 9, "pills": 30, "pill": 40, "s": 5, "the": 500, "now": 60, "no": 80, "w": 3}
    segment = u.Segmenter(counts)
    assert segment("cheappillsnow") == ["cheap", "pills", "now"]
    assert segment("thezzqnow") == ["the", "zzq", "now"]
    total = sum(counts.values())

    def cost(words):
        return sum(-math.log(counts[w] / total) if w in counts else math.log(total) + math.log(10) * (1 + len(w)) for w in words)

    rng = random.Random(14)
    for _ in range(60):
        name = "".join(rng.choice([*counts, "q", "zz"]) for _ in range(3))[:11]
        options = []
        for cuts in itertools.product([0, 1], repeat=len(name) - 1):
            at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(name)]
            options.append(cost([name[a:b] for a, b in zip(at, at[1:])]))
        got = segment(name)
        assert "".join(got) == name and math.isclose(cost(got), min(options))
    assert len("".join(segment("ab" * 50_000))) == 100_000 and segment("") == []


def test_verdicts_of_rules_and_model(spark):
    rng = random.Random(15)
    good, bad = ["garden", "river", "school", "paper"], ["lottery", "jackpot", "torrent"]
    html = "<script>hidden</script><p>" + " ".join(good + bad) * 3 + "</p>"
    rows = []
    for i in range(400):
        names = rng.choice([good, bad])
        host = "".join(rng.choice(names) for _ in range(2)) + (".fine" if names is good else ".evil")
        rows.append((i, f"http://{host}/{rng.choice(names)}/{i}", html))
    rows += [(1000 + i, f"http://{''.join(rng.choice(good) for _ in range(3))}.other/a", html) for i in range(20)]
    rows += [(2000 + i, f"http://{''.join(rng.choice(bad) for _ in range(3))}.other/a", html) for i in range(20)]
    rows += [(3000, "https://spam-farm.other/x", None), (3001, None, ""), (3002, "nothing", html), (None, "http://a.fine/", html)]
    got = {r.page_id: r for r in u.judged(frame(spark, rows), [("fine/", "allow"), ("evil/", "block")]).collect()}
    assert len(got) == len(rows)
    assert all(got[i].verdict == ("allow" if got[i].rule == "fine/" else "block") and got[i].rule for i in range(400))
    assert all(got[1000 + i].verdict == "allow" and got[1000 + i].rule is None for i in range(20))
    assert all(got[2000 + i].verdict == "block" for i in range(20))
    assert (got[3000].verdict, got[3001].verdict, got[3001].host, got[None].rule) == ("block", "allow", "", "fine/")


def test_empty_table(spark):
    assert u.judged(frame(spark, [])).count() == 0


def test_weights_against_plain_naive_bayes(spark):
    rng = random.Random(9)
    counts = {f"{rng.choice('hp')}:w{i}": (n := rng.randint(1, 40), rng.randint(0, n)) for i in range(300)}
    counts |= {"h:casino": (9, 2), "p:shop": (30, 1)}
    found = spark.createDataFrame([(t, n, b) for t, (n, b) in counts.items()], "token string, n bigint, blocked bigint")
    got = {r.token: r.weight for r in u.log_odds(found, ()).collect()}
    bad, all_ = sum(b for _, b in counts.values()), sum(n for n, _ in counts.values())
    vocabulary = len(counts) + 1  # and one for what was never seen
    for token, (n, b) in counts.items():
        plain = math.log((b + u.SMOOTHING) / (bad + u.SMOOTHING * vocabulary)) - math.log((n - b + u.SMOOTHING) / (all_ - bad + u.SMOOTHING * vocabulary))
        if token[2:] in u.SEEDS:
            assert got[token] > plain
        else:
            assert got[token] == pytest.approx(plain, abs=1e-12)
    assert set(got) == set(counts) | {m + w for w in u.SEEDS for m in ("h:", "p:")}


def test_verdicts_are_the_sums_of_the_weights(spark):
    rng = random.Random(10)
    pool = ["alpha", "beta", "gamma", "delta", "omega"]
    rows = [(i, f"http://{rng.choice(pool)}.{rng.choice(['fine', 'evil'])}/{rng.choice(pool)}{i % 3}", " ".join(pool * 3)) for i in range(200)]
    rows += [(500 + i, f"http://{a}{b}.other/{b}", "") for i, (a, b) in enumerate((a, b) for a in pool for b in pool)]
    rules = [("fine/", "allow"), ("evil/", "block")]
    pages = frame(spark, rows)
    uses = u._uses(u._placed(pages), rules)
    weights = {r.run: r.weight for r in u.run_weights(uses, pages, rules).collect()}
    for r in u.judged(pages, rules).collect():
        score = sum(weights.get(run, 0.0) for run in u.marked_runs(r.host, r.path))
        assert r.score == pytest.approx(score, abs=1e-9)
        assert r.rule or r.verdict == ("block" if score >= math.log(u.MIN_ODDS) else "allow")


def test_rare_words_count_however_many_words_there_are(spark):
    # 60,000 commoner words stand before the two that decide
    words = " ".join("".join(chr(97 + i // 26**k % 26) for k in range(4)) + "q" for i in range(60_000))
    rows = [(0, "http://a.fine/", f"<p>{words} {words}</p>"), (1, "http://a.fine/", "<p>zzuno zzdue</p>")]
    rows += [(2 + i, "http://zzdue.evil/", "") for i in range(5)] + [(9, "http://zzunozzdue.other/", None)]
    got = {r.page_id: r for r in u.judged(frame(spark, rows), [("fine/", "allow"), ("evil/", "block")]).collect()}
    # the rare word is split off, and weighs
    assert len(got) == len(rows) and got[9].score > 1 and got[9].rule is None


def test_counts_outweigh_seed_words(spark):
    rows = [(i, f"http://farm.fine/{i}", "") for i in range(60)] + [(100 + i, f"http://lottery.evil/{i}", "") for i in range(60)]
    rows += [(200, "http://farm.other/", ""), (201, "http://casino.other/", ""), (202, "http://lottery-casino.other/", "")]
    got = {r.page_id: r for r in u.judged(frame(spark, rows), [("fine/", "allow"), ("evil/", "block")]).collect()}
    # sixty allowed addresses speak for one seed word, none for the other
    assert (got[200].verdict, got[201].verdict, got[202].verdict) == ("allow", "block", "block")
