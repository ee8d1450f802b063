"""Quality rules, fingerprints and URL filter against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from repometrics.llm import quality, simhash, url_filter
from repometrics.llm.queries import URL_RULES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measured(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {k + d for k, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_measures(odd_docs, odd_rows, no_docs):
    rows = [(i, t) for i, t in odd_rows] + [(90, "a b c a b c a b"), (91, "x # y\nx # y\n\n \n<|>"), (92, "a a a a"), (93, "a b")]
    docs = odd_docs.unionByName(odd_docs.sparkSession.createDataFrame(rows[-4:], "doc_id long, text string"), allowMissingColumns=True)
    got = quality.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    expected = [(i, *(m := measured(t)), m[0] < 50 or 100 * m[4] > 50 * m[0]) for i, t in rows]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, expected))
    assert quality.judge(no_docs).count() == 0 and quality.keep(no_docs).columns == no_docs.columns


def test_limits_follow_each_source(spark):
    """The same text is bad in a tidy source and usual in one that is full of symbols."""
    plain = " ".join(f"word{i}" for i in range(100))
    marked = " ".join(f"word{i}" + "#" * (i % 2) for i in range(100))
    rows = [(i, f"{plain} {i}", "en", "tidy") for i in range(600)] + [(i, f"{marked} {i}", "en", "code") for i in range(600, 1200)]
    rows += [(2000, marked, "en", "tidy"), (2001, marked, "en", "code"), (2002, marked, None, None)]
    got = dict(quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).select("doc_id", "kept").collect())
    assert not got[2000] and got[2001]
    assert all(v for k, v in got.items() if k < 1200)


def above(row):
    return [m for m in quality.MEASURES if row[m] > row[f"{m}_limit"]]


def test_each_measure_rejects_by_itself(spark):
    """One text for each measure that no other measure rejects."""
    lines = lambda i: "\n".join(" ".join(f"w{i}x{k}y{j}" for j in range(10)) for k in range(8))
    rows = [(i, lines(i), "en", "tidy") for i in range(300)]
    phrases = lambda n: " ".join(["a b c d e"] * (n // 5) + [f"q{k}" for k in range(100 - n)])
    planted = {
        2000: ("symbols_per_word", " ".join(f"p{k}###" for k in range(100))), 2001: ("mean_word_chars", " ".join(f"p{k}" + "x" * 20 for k in range(100))),
        2002: ("dup_line_share", "\n".join(f"x\nx\np{k}" for k in range(40))), 2003: ("repeat_word_share", phrases(45)),
    }
    rows += [(i, t, "en", "tidy") for i, (_, t) in planted.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    for i, (measure, _) in planted.items():
        assert above(got[i]) == [measure] and not got[i].base_failed and not got[i].kept, (measure, got[i])
    assert all(got[i].kept for i in range(300))
    assert all(r.repeat_word_share_limit < 0.5 and r.dup_line_share_limit < 1 for r in got.values())


def test_limits_of_shares_follow_the_source(spark):
    """Half of all lines repeated: kept where that is usual, rejected where it isn't."""
    text = lambda i, n: "\n".join([x for k in range(n) for x in ("x", f"a{i}b{k}")] + [f"c{i}d{k}" for k in range(100 - 2 * n)])
    rows = [(i, text(i, 0), "en", "tidy") for i in range(300)] + [(1000 + i, text(i, 30 + i % 20), "en", "lists") for i in range(300)]
    rows += [(2000, text(9999, 48), "en", "tidy"), (2001, text(9999, 48), "en", "lists")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert not got[2000].kept and above(got[2000]) == ["dup_line_share"] and got[2001].kept
    assert all(r.kept for k, r in got.items() if k < 2000)


def verdicts(rows, spread=8.0, prior=20):
    """The limits computed anew: buckets, quantiles, leaning on wider groups."""
    found = []
    for k, (text, lang, source) in enumerate(rows):
        n, chars, symbols, dup, rep = measured(text)
        lines = len([x for x in (text or "").split("\n") if WORD.search(x)])
        values = {"symbols_per_word": symbols / max(n, 1), "mean_word_chars": chars / max(n, 1), "dup_line_share": dup / max(lines, 1), "repeat_word_share": rep / max(n, 1)}
        found.append((k, lang, source, values, n < 50 or 100 * rep > 50 * n))
    held = {}
    for _, lang, source, values, failed in found:
        for m, v in values.items():
            for group in ((lang, source), (lang,), ()):
                if not failed:
                    held.setdefault((m, group), []).append(quality.ZERO if v <= 0 else math.ceil(math.log(v) / math.log(quality.GAMMA)))

    def limit(m, group):
        b = sorted(held[m, group])
        low, mid, high = (0.0 if (x := b[math.floor(q * (len(b) - 1))]) == quality.ZERO else 2 * quality.GAMMA**x / (quality.GAMMA + 1) for q in (0.25, 0.5, 0.75))
        if m in quality.SHARES:
            return mid + min(spread * max(high - mid, quality.MEASURES[m]), quality.REACH * (quality.SHARES[m] - mid)), len(b)
        return mid + spread * max(mid - low, quality.MEASURES[m]), len(b)

    def kept(lang, source, values):
        for m, v in values.items():
            wide = limit(m, ())[0]
            for group in ((lang,), (lang, source)):
                own, n = limit(m, group)
                wide = (n * own + prior * wide) / (n + prior)
            if v > wide:
                return False
        return True

    return {k: not failed and kept(lang, source, values) for k, lang, source, values, failed in found}


def test_verdicts_computed_anew_and_in_any_order(spark):
    """Limits from scratch give the same verdicts; so do other partitions, another order and a second run."""
    rng = random.Random(8)
    rows = []
    for k in range(700):
        lang, source = rng.choice(["en", "fr", None]), rng.choice(["a", "a", "a", "b", None, "few" if k < 40 else "a"])
        words = [("x" * rng.randint(1, 12 if source == "b" else 6)) + str(rng.randrange(40 if k % 9 == 0 else 900)) + ("#" * rng.randint(0, 3) if rng.random() < (0.4 if k % 11 == 0 else 0.03) else "") for _ in range(rng.randint(30, 160))]
        text = "".join(w + rng.choice([" ", " ", " ", "\n"]) for w in words)
        rows.append((text + ("same line\n" * rng.randint(0, 25) if k % 7 == 0 else ""), lang, source))
    expected = verdicts(rows)
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string")
    runs = [{r.doc_id: r.kept for r in quality.judge(f).collect()} for f in (frame, frame.repartition(5, "text"), frame.orderBy(F.rand(3)).coalesce(1))]
    assert runs == [expected] * 3 and 20 < sum(expected.values()) < 690


def test_keep_returns_the_rows(odd_docs):
    kept = quality.keep(odd_docs)
    good = {r.doc_id for r in quality.judge(odd_docs).filter("kept").collect()}
    assert kept.columns == odd_docs.columns and {r.doc_id for r in kept.collect()} == good and good


def brute_print(text):
    """Votes one by one, with Spark's hash of a term."""
    return Counter(zip(text.split(" "), text.split(" ")[1:]))


def test_edited_text_and_near_counts(odd_docs, odd_rows, no_docs):
    rows = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    texts = [t or "" for _, t in rows]
    expected = []
    for k, (i, _) in enumerate(rows):
        t, following = texts[k], texts[(k + 1) % len(rows)]
        half = len(t) // 2
        expected.append((i, len(t), hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest()))
    found = simhash.compare_with_edited(odd_docs).collect()
    assert sorted(str(tuple(r[:3])) for r in found) == sorted(map(str, expected))
    prints = {}
    for r in found:
        prints.setdefault(r.doc_id, set()).add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert prints[1] == prints[5] and prints[2] == prints[3] == {"0" * 16}
    every = [int(r.fingerprint, 16) for r in found]
    for r in found:
        if r.doc_id is not None and r.doc_id % 50 == 0:
            assert r.n_near == sum((int(r.fingerprint, 16) ^ x).bit_count() <= 3 for x in every) - 1
    assert simhash.compare_with_edited(no_docs).count() == 0


def test_fingerprint_bits(spark):
    text = "to be or not to be or to go"
    words = text.split()
    terms = [spark.range(1).select(F.xxhash64(F.lit(a), F.lit(b))).first()[0] for a, b in zip(words, words[1:])]
    votes = [sum(t >> k & 1 for t in terms) for k in range(64)]
    expected = sum(1 << k for k, v in enumerate(votes) if 2 * v > len(terms))
    got = simhash.fingerprints(spark.createDataFrame([(1, text)], "k long, text string"), ["k"]).first().fp
    assert got % (1 << 64) == expected


@pytest.mark.parametrize("radius,blocks", [(3, 6), (2, 4), (0, 3)])
def test_block_tables_find_all(spark, radius, blocks):
    rng = __import__("random").Random(5)
    base = [rng.getrandbits(64) for _ in range(12)]
    prints = [b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(12)]
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    frame = spark.createDataFrame(signed, "fp long")
    got = dict(simhash.near_counts(frame, frame, radius, blocks).collect())
    assert got == {s: sum((p ^ q).bit_count() <= radius for q in prints) for (s,), p in zip(signed, prints)}


def judged(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    return lowered, re.match("[^?#]*", rest[len(host):])[0]


URLS = ["http://A.Example.COM/en/1", "https://www.example.com/en/2?x=/en/", "http://example.com", "http://x.net/es/", "ftp://x.net/fr", "http://notexample.com/en/",
        "http://y.org/a", None, "", "no scheme", "http://example.com/en/", "http://É.net/fr/ü#://", "http://z.org?q", "://h/p", "http://", "http://y.org/a"]


def test_hosts_and_rules(spark):
    pages = spark.createDataFrame([(k, u, None, "x", "y") for k, u in enumerate(URLS)], "page_id long, url string, html string, host string, rule string")
    got = {r.page_id: r for r in url_filter.judge_urls(pages, URL_RULES).collect()}
    for k, url in enumerate(URLS):
        host, path = judged(url)
        fits = [r for r in URL_RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/"):])]
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, max(fits, key=len, default=None)), url
        if fits:
            assert got[k].verdict == URL_RULES[got[k].rule]
    assert got[6].verdict == "allow" and got[7].verdict == "allow"
    assert url_filter.judge_urls(pages.limit(0), URL_RULES).count() == 0


def test_trust_goes_along_links_and_distrust_back(spark):
    link = lambda *targets: "".join(f'<a href="http://{t}/x">' for t in targets)
    rows = [(1, "http://good.com/", link("friend.org") * 3), (2, "http://friend.org/", link("Friend2.org")), (3, "http://friend2.org/", '<a href="/own">'),
            (4, "http://spam.net/es/", link("good.com")), (5, "http://feeds.org/", link("spam.net", "spam.net")), (6, "http://alone.org/", None), (7, "http://spam.net/de/", "")]
    got = {r.page_id: r for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), URL_RULES).collect()}
    assert [got[k].verdict for k in range(1, 8)] == ["allow", "allow", "allow", "block", "block", "allow", "block"]
    # brute force over the same edges
    edges = {("good.com", "friend.org"): 3, ("friend.org", "friend2.org"): 1, ("friend2.org", "friend2.org"): 1, ("spam.net", "good.com"): 1, ("feeds.org", "spam.net"): 2}

    def rank(edges, seeds):
        out = Counter()
        for (a, _), n in edges.items():
            out[a] += n
        p = {h: 0.15 * s for h, s in seeds.items()}
        for _ in range(600):
            new = Counter({h: 0.15 * s for h, s in seeds.items()})
            for (a, b), n in edges.items():
                new[b] += 0.85 * p.get(a, 0) * n / out[a]
            p = new
        return p

    trust, distrust = rank(edges, {"good.com": 1}), rank({(b, a): n for (a, b), n in edges.items()}, {"spam.net": 1})
    for r in got.values():
        assert r.trust == pytest.approx(trust.get(r.host, 0)) and r.distrust == pytest.approx(distrust.get(r.host, 0))


def test_propagation_has_no_last_round(spark):
    """A chain of 40 hosts that leads to a blocked one, a ring, and a chain from an allowed one."""
    link = lambda *targets: "".join(f'<a href="http://{t}/x">' for t in targets)
    rows = [(k, f"http://h{k}.org/", link(f"h{k + 1}.org" if k < 39 else "spam.net", *([f"h{k}.org"] * (k % 3)))) for k in range(40)]
    rows += [(100, "http://spam.net/es/", None), (101, "http://good.com/", link("r0.org", "t0.info"))]
    rows += [(110 + k, f"http://r{k}.org/", link(f"r{(k + 1) % 5}.org")) for k in range(5)]
    rows += [(200 + k, f"http://t{k}.info/", link(f"t{k + 1}.info")) for k in range(40)]
    got = {r.page_id: r for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), URL_RULES).collect()}
    assert [k for k in range(40) if got[k].verdict != "block"] == [] and got[100].verdict == "block"
    assert all(got[k].verdict == "allow" and got[k].trust > 0 for k in (*range(110, 115), *range(200, 240)))
    # all around the ring: half of what good.com gives, and the rest as it goes round
    assert got[110].trust == pytest.approx(0.15 * 0.85 / 2 / (1 - 0.85**5), rel=1e-8)


def test_near_documents(spark, odd_docs):
    """Pairs of fingerprints and their members, against all pairs of documents."""
    rng = random.Random(12)
    rows = []
    for f in range(6):
        words = [f"f{f}w{rng.randrange(400)}" for _ in range(400)]
        for k in range(6):
            rows.append((len(rows), " ".join([*words[: 400 - k], *(f"e{k}x{j}" for j in range(k))])))
    docs = spark.createDataFrame([*rows, (100, rows[0][1]), (100, rows[0][1]), (None, rows[1][1])], "doc_id long, text string")
    pairs, members = simhash.near_documents(docs, radius=4, blocks=7)
    prints = {(r.doc_id, r.fp) for r in members.collect()}
    assert {d for d, _ in prints} == {*range(36), 100, None}
    known = sorted({f for _, f in prints})
    unsigned = lambda x: x % (1 << 64)
    expected = {(a, b, (unsigned(a) ^ unsigned(b)).bit_count()) for a in known for b in known if a < b and (unsigned(a) ^ unsigned(b)).bit_count() <= 4}
    assert {tuple(r) for r in pairs.collect()} == expected and len(expected) > 10
    assert dict(prints)[100] == dict(prints)[0]
    assert simhash.near_documents(odd_docs.limit(0))[0].count() == 0
