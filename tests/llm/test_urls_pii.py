import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from entrofield.llm import pii as P
from entrofield.llm import url_filter as U

# ---------------------------------------------------------------- urls


def brute_ratio(accepted, rejected, least):
    """The smoothed variable-order models by their recursive definition."""

    def model(urls):
        n = {}
        for u in urls:
            for i in range(U.ORDER, len(u)):
                for k in range(U.ORDER + 1):
                    n[u[i - k : i], u[i]] = n.get((u[i - k : i], u[i]), 0) + 1
                    n[u[i - k : i]] = n.get(u[i - k : i], 0) + 1

        def p(h, c):
            lower = 1 / U.SYMBOLS if not h else p(h[1:], c)
            return (n.get((h, c), 0) + U.BETA * lower) / (n.get(h, 0) + U.BETA)

        return p

    a, r = model(accepted), model(rejected)
    seen = Counter(u[i - k : i] for u in accepted + rejected for i in range(U.ORDER, len(u)) for k in range(U.ORDER + 1))

    def ratio(h, c):
        while h and seen[h] < least:
            h = h[1:]
        return math.log(a(h, c)) - math.log(r(h, c))

    def score(u):
        return sum(ratio(u[i - U.ORDER : i], u[i]) for i in range(U.ORDER, len(u))) / (len(u) - U.ORDER)

    return score


def symbols(url):
    return "^" * U.ORDER + "".join(c if c in U.ALPHABET[1:-1] else "\0" for c in (url or "").lower()) + "^"


URLS = ["http://a.example.net/en/1", "https://b.example.net/de/2?x", "http://WWW.Example.ORG/fr/9#q", "http://example.com/de/3", "http://example.com/en/4", "http://foo.net", "ftp://x.org/fr/", "nothing", None, "", "http://notexample.net/en/", "http://h?/fr/", "http://user@ex.org:80/fr/5", "http://é.example.org/de/1"]


@pytest.fixture(scope="module")
def judged(spark):
    rows = [(i, u, "h", "v", 1.0) for i, u in enumerate(URLS * 4)] + [(None, URLS[0], "h", "v", 1.0)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string, score double")
    return U.judge(df).toPandas()


def rule(url):
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest, re.S).groups()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [h + p for h, p, _ in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fit, key=len, default=None)


def test_rules_and_parts(judged):
    assert len(judged) == 4 * len(URLS) + 1
    for r in judged.itertuples():
        u = URLS[int(r.page_id) % len(URLS)] if r.page_id == r.page_id else URLS[0]
        assert (r.host, r.path, r.rule if isinstance(r.rule, str) else None) == rule(u)
        if isinstance(r.rule, str):
            assert r.verdict == {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}[r.rule]


def test_scores_equal_brute_force(judged):
    every = URLS * 4 + [URLS[0]]
    verdict = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    acc = [symbols(u) for u in every if verdict.get(rule(u)[2]) == "allow"]
    rej = [symbols(u) for u in every if verdict.get(rule(u)[2]) == "block"]
    score = brute_ratio(acc, rej, U.LEAST)
    for r in judged.itertuples():
        u = URLS[int(r.page_id) % len(URLS)] if r.page_id == r.page_id else URLS[0]
        assert r.score == pytest.approx(score(symbols(u)), abs=1e-4)


def test_all_contexts_are_kept(spark, monkeypatch):
    """Long contexts are kept where they are frequent; with room for few contexts in a broadcast, the others are joined, and scores follow the definition of the whole model all the same."""
    urls = [f"http://{'cheap' if i % 2 else 'news'}{i % 3}.{'net' if i % 2 else 'org'}/{'en' if i % 2 else 'fr'}/{i % 10}" for i in range(60)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for most in (50_000, 60):
        monkeypatch.setattr(U, "CONTEXTS", most)
        labelled = df.select("url", F.col("url").contains(".org/fr/").alias("allow"))
        least = U.evidence(U.context_counts(labelled))
        assert (least == U.LEAST) == (most == 50_000)
        score = brute_ratio([symbols(u) for u in urls if ".org/fr/" in u], [symbols(u) for u in urls if ".org/fr/" not in u], U.LEAST)
        for r in U.judge(df).collect():
            assert r.score == pytest.approx(score(symbols(urls[r.page_id])), abs=1e-4)


def test_rest_of_the_tree_counts_for_every_row(spark, monkeypatch):
    """Whatever part of the tree is broadcast, all rows (copies, null and odd urls, null and repeated keys) get equal results."""
    urls = [*URLS, *[f"http://{'cheap' if i % 2 else 'news'}{i % 3}.{'net' if i % 2 else 'org'}/{'en' if i % 2 else 'fr'}/{i % 10}" for i in range(60)], *[f"http://same.example.com/xx/{i % 4}" for i in range(40)]]
    df = spark.createDataFrame([(i % 90 if i % 7 else None, u) for i, u in enumerate(urls * 2)], "page_id long, url string").repartition(5)
    key = lambda r: str(tuple(r))
    whole = sorted(U.judge(df).collect(), key=key)
    assert len(whole) == 2 * len(urls)
    for most in (1, 60):
        monkeypatch.setattr(U, "CONTEXTS", most)
        assert sorted(U.judge(df).collect(), key=key) == whole


def test_null_urls_only_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, 1, 2, 3), (None, None, 1, 2, 3), (2, "", 1, 2, 3)], "page_id long, url string, id int, `row` int, length int")
    rows = U.judge(df).collect()
    assert len(rows) == 3 and all(r.host == "" and r.path == "" and r.rule is None and r.verdict == "allow" and r.score == 0.0 for r in rows)


def test_urls_without_training(spark):
    df = spark.createDataFrame([(1, "http://x.example.com/en/")], "page_id long, url string")
    assert U.judge(df).first().verdict == "allow"
    assert U.judge(df.limit(0)).count() == 0


def test_separates_held_out_urls(spark):
    rows = [(i, f"http://{'cheap' if i % 2 else 'news'}{i % 7}.{'net' if i % 2 else 'org'}/{'en' if i % 2 else 'fr'}/{i}") for i in range(300)]
    rows += [(1000 + i, f"http://{'cheap' if i % 2 else 'news'}{i % 5}.example.com/xx/{i}") for i in range(40)]
    got = {r.page_id: r.verdict for r in U.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert sum(got[1000 + i] == ("block" if i % 2 else "allow") for i in range(40)) >= 36


# ---------------------------------------------------------------- personal data

KEY = b"test"
TEXT = "Dear Mrs Schmidt, Katharina Müller (k.müller+x@Firma-online.de, K.MÜLLER+X@FIRMA-ONLINE.DE) met Sebastian Bach-Meier. Müller paid with 4111 1111 1111 1111, IBAN DE89 3704 0044 0532 0130 00, tel 030-555-1234, +49 30 1234567, SSN 078-05-1120, host 10.0.0.1. Анастасия Иванова."


@pytest.fixture(scope="module")
def sur():
    return P.Surrogates(KEY)


def test_types_format_and_coreference(sur):
    new, found = P.replace(TEXT, sur)
    assert [k for k, _, _ in found] == ["last", "first", "last", "email", "email", "first", "last", "last", "account", "iban", "phone", "phone", "ssn", "ip", "first", "last"]
    by = {}
    for k, a, b in found:
        assert len(a) == len(b) or k in ("first", "ip")
        assert a != b and by.setdefault((k, P.canonical(k, a)), P.canonical(k, b)) == P.canonical(k, b)
    s = {a: b for _, a, b in found}
    kind = lambda x: sur.given[x][2]
    assert kind(s["Katharina"]) == ("latin", "f") and kind(s["Sebastian"]) == ("latin", "m") and kind(s["Анастасия"]) == ("cyrillic", "f")
    assert P.luhn(s["4111 1111 1111 1111"].replace(" ", "")) == 0 and P.iban_valid(s["DE89 3704 0044 0532 0130 00"])
    assert all(0 <= int(x) < 256 for x in s["10.0.0.1"].split(".")) and s["+49 30 1234567"].startswith("+49 ")
    assert s["k.müller+x@Firma-online.de"].lower() == s["K.MÜLLER+X@FIRMA-ONLINE.DE"].lower()
    assert P.collisions(found) == 0 and not [a for _, a, _ in found if a in new and len(a) > 9]


def test_one_number_one_surrogate(sur):
    """Separators don't matter, the calling code stays, and numbers of other codes or without one don't meet."""
    same = ["+1 555 123 4567", "+15551234567", "+1 (555) 123-4567", "+1-555-123-4567"]
    assert len({P.canonical("phone", sur("phone", x)) for x in same}) == 1 and sur("phone", same[2])[:4] == "+1 ("
    assert sur("phone", "+49 30 1234567").startswith("+49 ") and sur("phone", "+35312345678").startswith("+353") and sur("phone", "+7 495 123 45 67").startswith("+7 ")
    seen = {}
    for code in ("1", "7", "20", "49", "353"):
        for i in range(3000):
            text = f"+{code} {2000000 + i * 7}"
            seen.setdefault(P.canonical("phone", sur("phone", text)), set()).add(P.canonical("phone", text))
    assert all(len(v) == 1 for v in seen.values()) and len(seen) == 15_000


def test_addresses_stay_in_their_range(sur):
    import ipaddress

    for x in ("10.1.2.3", "192.168.0.1", "172.20.1.1", "127.0.0.1", "169.254.3.4", "0.0.0.7", "224.0.0.5", "240.56.125.154", "8.8.8.8", "172.32.0.1", "193.168.0.1"):
        a, b = (ipaddress.ip_address(v) for v in (x, sur("ip", x)))
        assert a != b
        assert [a.is_private, a.is_loopback, a.is_link_local, a.is_multicast, a.is_reserved] == [b.is_private, b.is_loopback, b.is_link_local, b.is_multicast, b.is_reserved] or not a.is_private
        assert P.range_of(list(a.packed))[0] == P.range_of(list(b.packed))[0]
    private = [f"192.168.{i // 256}.{i % 256}" for i in range(65536)]
    assert sorted(sur.ip(x) for x in private) == sorted(private)


def test_families_keep_stem_and_gender(sur):
    for man, woman in (("Иванов", "Иванова"), ("Достоевский", "Достоевская"), ("Petrov", "Petrova"), ("Kowalski", "Kowalska")):
        a, b = sur("last", man), sur("last", woman)
        end, other = P.surname_ending(man)[0], P.surname_ending(woman)[0]
        assert a.endswith(end) and b.endswith(other) and a[: -len(end)] == b[: -len(other)] and a != man
    text = "Анастасия Иванова met her brother. Иванов said so."
    assert [k for k, _, _ in P.replace(text, sur)[1]] == ["first", "last", "last"]


def test_names_by_list_title_and_cue(sur):
    """Recall on names outside of the lists where a title or cue is before them, and on common names."""
    for text, want in (("then Alice Johnson left", 2), ("so Bob Smith and Maria Garcia", 4), ("Anna Müller", 2), ("saw Dr Adams today", 1), ("my name is Xandria Vexley.", 2), ("Name: Qorbin\nx", 1), ("меня зовут Зульфия Ахметова", 2)):
        assert len(P.replace(text, sur)[1]) == want, text
    assert sur("first", "Xandria").endswith("a") and sur("first", "Xandria") not in sur.given
    for clean in ("The Report of the Bank said so", "Dear Sir or Madam", "the File Name is here", "New York City"):
        assert P.replace(clean, sur) == (clean, [])


def test_no_collisions_among_many(sur):
    """Distinct entities of a type, of formats that could meet, keep distinct surrogates that are never their own."""
    rng = random.Random(3)
    make = {
        "secret": lambda: "".join(rng.choice("0123456789abcdef" if rng.random() < 0.5 else "0123456789abcdefghijk") for _ in range(16)),
        "last": lambda: "".join(rng.choice("bcdlmn") + rng.choice("aeio") for _ in range(3)).capitalize() + rng.choice(["", "ov", "ova", "ski", "ska"]),
        "first": lambda: "".join(rng.choice("bcdlmn") + rng.choice("aeio") for _ in range(3)).capitalize() + rng.choice(["", "n", "ina", "ella"]),
        "ip": lambda: ".".join(str(rng.choice([10, 127, 172, 192, 168, 20, 224, 9, 255])) for _ in range(4)),
        "email": lambda: f"{rng.choice('abc')}{rng.randrange(3000)}@mail{rng.randrange(9)}.org",
        "account": lambda: "".join(rng.choice("0123456789") for _ in range(13)),
    }
    for kind, one in make.items():
        every = {one() for _ in range(8000)}
        image = {x: sur(kind, x) for x in every}
        assert len(set(image.values())) == len(every) and all(a != b for a, b in image.items()), kind
        assert all(len(a) == len(b) or kind in ("ip", "first") for a, b in image.items())


@pytest.mark.parametrize("radix", [[10], [10, 10], [26, 10, 3], [2, 2, 2]])
def test_permutations_without_fixed_points(radix):
    import itertools

    p = P.Permuter(KEY)
    every = list(itertools.product(*map(range, radix)))
    image = [tuple(p(list(x), radix, "t")) for x in every]
    assert sorted(image) == sorted(every) and all(a != b for a, b in zip(every, image))


def test_clean_text_stays(sur, texts):
    for t in [*texts, "In 1999-2000 it rose by 12.5 (3) and 1.2.3.4.5, version 10.2.1 of 2024-01-02, a@b, 1234 5678", "x 999.1.1.1 y"]:
        assert P.replace(t, sur) == (t, [])


def test_key_matters(sur):
    assert P.replace(TEXT, sur)[0] != P.replace(TEXT, P.Surrogates(b"other"))[0]


def test_on_tables(spark, docs, empty):
    extra = docs.limit(1).selectExpr("cast(777 as long) doc_id", f"'{TEXT}' text", "lang", "source", "n_chars", "size", "kind", "class", "shard", "`row`", "`text_x.y`")
    df = docs.unionByName(extra).unionByName(extra)
    out = P.pseudonymise(df, KEY)
    assert out.columns == df.columns and out.count() == df.count()
    rep = P.pseudonymised(df, KEY).where("n_entities > 0").collect()
    assert len(rep) == 2 and rep[0].text == rep[1].text != TEXT and rep[0].collisions == 0
    assert P.collision_report(df, KEY).count() == 0
    assert P.pseudonymise(empty, KEY).count() == 0 and P.pseudonymised(empty, KEY).count() == 0


def test_query_equals_brute_force(spark, sf):
    """Every row of the registered query against a loop over the texts."""
    from entrofield.llm.queries import PII_KEY, op4_pii

    one = P.Surrogates(PII_KEY)
    want = Counter()
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        spans = P.entities(r.text, one.given) if r.text else []
        text, kinds = r.text, Counter(k for _, _, k in spans)
        for a, b, k in reversed(spans):
            text = text[:a] + getattr(one, k)(text[a:b]) + text[b:]
        want[r.doc_id, text, len(spans), ",".join(f"{k}:{n}" for k, n in sorted(kinds.items())), 0] += 1
    assert Counter(tuple(r) for r in op4_pii(spark, sf).select("doc_id", "text", "n_entities", "kinds", "collisions").collect()) == want


def test_very_long_text(sur):
    text = "lorem ipsum " * 200_000 + "Alice Johnson +1 555 123 4567"
    new, found = P.replace(text, sur)
    assert len(found) == 3 and new.startswith("lorem ipsum ") and len(new) >= len(text) - 12
