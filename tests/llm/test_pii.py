import hashlib
import math
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from loomwright.llm import pii
from loomwright.llm.queries import op2_pii


def luhn(s):
    t = 0
    for i, c in enumerate(reversed(s)):
        x = int(c) * (2 if i % 2 else 1)
        t += x - 9 if x > 9 else x
    return t % 10 == 0


def brute(t):
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    out += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def check(rows, texts):
    assert len(rows) == len(texts)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    for i, t in texts:
        r, want = by[i][0] if len(by[i]) == 1 else by[i].pop(), brute(t or "")
        text = ",".join(f"{k}:{s}:{e}" for s, _, e, k in want)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[3] == k for x in want) for k in pii.KINDS]
        assert [x for x in r["spans"].split(",") if x and not x.startswith("term")] == [x for x in text.split(",") if x]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, spans long")


def test_edges(spark):
    texts = [
        (1, None), (2, ""), (3, "a@b.c@d.e x@y.z_d@e.f @a.b a@-.-- x..%@a.b.c. y@z"), (4, "1.2.3.4.5.6.7.8 999.1.1.1 0001.02.3.255é 1.2.3"), (5, "4785380592391139 4111 1111-1111 1111 4111  1111 1111 1111"),
        (6, "+1 (743) 555-3824 +12345678901234567890 +1 23 é+1 234567890-- ++1 2345678901"), (7, "é😀 me@x.org 😀"), (8, "1" * 30000 + " " + "a" * 30000 + "@b" + ".c" * 3000), (3, "dup@x.yz"), (None, "no@id.com"),
    ]
    check(pii.detect(frame(spark, texts)).collect(), texts)
    assert pii.detect(frame(spark, [])).count() == 0


def test_query(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(op2_pii(spark, sf).collect(), docs)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="ab@.-_ +()0149", max_size=50), min_size=20, max_size=20))
def test_random_texts(spark, texts):
    check(pii.detect(frame(spark, list(enumerate(texts)))).collect(), list(enumerate(texts)))


def leaks(spark):
    """A name that only stands beside one address, among words that stand everywhere."""
    common = ["with some other text around here", "that speaks about nothing much", "which goes along quite well now", "where words come back again often"]
    texts = [f"{common[k % 4]} {k} Zanzibarov boss@corp.com {common[(k + 1) % 4]}" for k in range(12)]
    texts += [f"{c} {k} plain" for k in range(60) for c in common]
    return frame(spark, list(enumerate(texts)))


def test_disclosive_terms(spark):
    df = leaks(spark)
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    for r in pii.detect(df).collect():
        terms = [texts[r["doc_id"]][int(a) : int(b)] for k, a, b in (x.split(":") for x in r["spans"].split(",") if x) if k == "term"]
        assert ("Zanzibarov" in terms) == (r["doc_id"] < 12) and "plain" not in terms and "with" not in terms
        assert r["n_term"] == len(terms)


def test_sanitise(spark):
    df = leaks(spark).unionByName(frame(spark, [(900, None), (901, ""), (902, "x 1.2.3.4 y")]))
    out = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert "boss" not in out[0] and "Zanzibarov" not in out[0] and "<email>" in out[0] and out[0].startswith("with some")
    assert (out[900], out[901], out[902]) == (None, "", "x <ip> y")
    assert pii.sanitise(df).columns == df.columns


def test_disclosive_terms_everywhere(spark):
    """Far from the address, in texts without it, and in repeated rows; not inside a finding or a longer word."""
    far = "Zanzibarov " + "so much other text stands in between " * 4 + "boss@corp.com"
    alone = "é😀 zanzibarov wrote this; Zanzibarovs did not, nor zanzibarov@else.org, but ZANZIBAROV"
    df = leaks(spark).unionByName(frame(spark, [(900, far), (901, alone), (901, alone), (None, "by Zanzibarov")] + [(1000 + k, "wrote this and Zanzibarovs") for k in range(9)]))
    out = [(r["doc_id"], r["text"]) for r in pii.sanitise(df).collect()]
    assert len(out) == df.count() and not any(re.search(r"\bzanzibarov\b", t, re.I) for _, t in out)
    assert [t for i, t in out if i == 901] == ["é😀 <term> wrote this; Zanzibarovs did not, nor <email>, but <term>"] * 2
    rows = [r for r in pii.detect(df).collect() if r["doc_id"] is None or 900 <= r["doc_id"] < 1000]
    assert sorted(r["n_term"] for r in rows) == [1, 1, 2, 2]
    assert {r["spans"] for r in rows if r["doc_id"] == 901} == {",".join(f"{k}:{a}:{b}" for a, b, k in [(3, 13, "term"), *[(m.start(), m.end(), "email") for m in re.finditer("zanzibarov@else.org", alone)], (len(alone) - 10, len(alone), "term")])}


def words_of(t):
    return [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^\W\d_]{4,}", t)]


def entities(kind, value):
    v, d = value.lower(), re.sub("[^0-9]", "", value)
    if kind == "email":
        return [f"whole:{v}", f"user:{v.split('@')[0]}", f"domain:{v.split('@')[-1]}"]
    if kind == "ip":
        return [f"whole:{v}", "net:" + ".".join(v.split(".")[:3])]
    return [f"whole:{v}", f"issuer:{d[:6]}" if kind == "card" else f"line:{d[:-4]}"]


def brute_terms(texts):
    """Disclosive terms with their replacement, from all texts, by the definition."""
    n_t, n_e, n_te = Counter(), Counter(), Counter()
    for t in texts:
        met = set()
        words, spans = words_of(t), brute(t)
        n_t.update(w.lower() for _, _, w in words)
        for s, _, e, kind in spans:
            lo, hi = max(0, s - pii.CONTEXT), min(len(t), e + pii.CONTEXT)
            for x in entities(kind, t[s:e]):
                n_e[x] += 1
                met.update((x, t[a:b].lower(), a) for a, b, _ in words if a >= lo and b <= hi and not any(a < y and z < b for z, _, y, _ in spans))
        n_te.update((x, w) for x, w, _ in met)
    n = sum(n_t.values())
    bits = lambda te, nt, e: -math.log2((min(te, nt) + pii.PRIOR * n_e[e] / n) / (nt + pii.PRIOR))
    out = {}
    for term in {w for (e, w), c in n_te.items() if bits(c, n_t[w], e) <= pii.GENERALISE}:
        own = [(e, bits(c, n_t[w], e)) for (e, w), c in n_te.items() if w == term and bits(c, n_t[w], e) <= pii.GENERALISE]
        put = "" if min(b for _, b in own) <= pii.REMOVE else "<term>"
        for k in range(len(term) - 1, 1, -1) if put else ():
            total = sum(c for w, c in n_t.items() if len(w) > k and w.startswith(term[:k]))
            if all(bits(sum(c for (x, w), c in n_te.items() if x == e and len(w) > k and w.startswith(term[:k])), total, e) >= pii.CLASS for e, _ in own):
                put = term[:k] + "*"
                break
        out[term] = put
    return out


def treated(text, puts):
    spans = brute(text)
    return [(a, b, puts[w.lower()]) for a, b, w in words_of(text) if w.lower() in puts and not any(a < e and s < b for s, _, e, _ in spans)]


def test_query_terms_against_brute_force(spark):
    """The given documents: spans, replacements and texts equal the definition, and the method finds terms."""
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    puts = brute_terms(list(texts.values()))
    assert len(puts) > 20 and any(p.endswith("*") for p in puts.values())
    hit = 0
    for r in op2_pii(spark, sf).collect():
        want = treated(texts[r["doc_id"]], puts)
        assert [x for x in r["spans"].split(",") if x.startswith("term")] == [f"term:{a}:{b}" for a, b, _ in want]
        assert r["n_term"] == len(want)
        hit += len(want)
    assert hit > 50
    for r in pii.sanitise(docs).collect():
        t, out, at = texts[r["doc_id"]], [], 0
        base = [(s, o, e, f"<{k}>") for s, o, e, k in brute(t)]
        for s, _, e, put in sorted(base + [(a, 9, b, p) for a, b, p in treated(t, puts)]):
            if e > at:
                out += [t[at : max(s, at)], put]
                at = e
        assert (r["text"] or "") == "".join(out) + t[at:]


def test_term_far_from_its_class(spark):
    """A term that two addresses share is generalised to a class of common words with its beginning."""
    texts = [f"hello planetoid x{k}@corp{k}.com bye" for k in range(2)] + ["planets planned plants planetary planks", "plan"] * 20
    got = {r["doc_id"]: r["text"] for r in pii.sanitise(frame(spark, list(enumerate(texts)))).collect()}
    assert got[0] == "hello planetoid <email> bye"  # one meeting for each address
    texts = [f"hello planetoid {k} me@corp.com bye" for k in range(2)] + ["hello planets planned plants planetary planks bye", "plan"] * 20
    got = {r["doc_id"]: r["text"] for r in pii.sanitise(frame(spark, list(enumerate(texts)))).collect()}
    assert got[0] == "hello planet* 0 <email> bye" and got[2] == texts[2]


def test_columns_of_any_name(spark):
    names = ["more", "key", "h_id", "h_key", "puts", "row", "base", "every", "spans", "term", "__key", "__t", "__all", "__spans"]
    rows = [(1, "x me@corp.org", *names), (None, None, *names), (1, "", *names)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    out = pii.sanitise(df)
    assert out.columns == df.columns
    assert sorted((r["text"] is None, r["text"]) for r in out.collect()) == [(False, ""), (False, "x <email>"), (True, None)]
    assert all([r[n] for n in names] == names for r in out.collect())
    assert pii.detect(df).count() == 3


def test_many_findings_in_one_text(spark):
    """Findings beyond a block of the running fold."""
    text = " ".join(f"a{k}@b{k}.org word 1.2.3.{k % 256}" for k in range(700))
    check(pii.detect(frame(spark, [(1, text)])).collect(), [(1, text)])
    assert pii.sanitise(frame(spark, [(1, text)])).first()["text"].count("<email>") == 700
