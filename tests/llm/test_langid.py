import numpy as np

from deckloom.llm import langid
from deckloom.llm.queries import op4_langid, table


def test_pages_and_documents(spark, sf_dir):
    rows = op4_langid(spark, sf_dir).collect()
    pages, docs = table(spark, sf_dir, "pages").count(), table(spark, sf_dir, "documents").count()
    assert (sum(r["page_id"] is not None for r in rows), sum(r["page_id"] is None for r in rows)) == (pages, docs)
    assert sum(r["language"] == r["declared"] for r in rows) >= 0.9 * len(rows)
    assert all(r["doc_id"] is not None for r in rows)


def test_evidence_is_fused(spark):
    """Three hosts: text decides where it can; a short text leans on its host
    and on what it declares; a wrong declaration does not win over a text."""
    en, fr = "the cat and the dog with the hat that they have", "le chat et le chien avec les mots que nous avons"
    rows = [(i, f"http://{'a' if i % 2 else 'b'}.example.{'uk' if i % 2 else 'fr'}/", (en, "en") if i % 2 else (fr, "fr")) for i in range(120)]
    pages = [(i, u, f'<html lang="{d}"><body><p>{t} {i}</p></body></html>') for i, u, (t, d) in rows]
    pages += [
        (1000, "http://a.example.uk/", "<p>ok</p>"), (1001, "http://b.example.fr/", "<p>ok</p>"), (1002, None, None), (1003, "x", ""),
        (1004, "http://new.example.fr/", f'<html lang="fr"><p>{en} {en}</p>'), (1004, "http://new.example.fr/", f'<html lang="fr"><p>{en} {en}</p>'),
    ]
    frame = spark.createDataFrame([(*p, "q", 0.5) for p in pages], "page_id long, url string, html string, language string, own double")
    got = langid.identify_pages(frame).collect()
    by = {r["page_id"]: r for r in got}
    assert len(got) == len(pages)
    assert by[1000]["language"] == "en" and by[1001]["language"] == "fr" and by[1004]["language"] == "en"
    assert not by[1002]["accepted"] and not by[1003]["accepted"] and by[1002]["text_language"] is None


def plain_fusion(rows, languages, s):
    """The posterior of each row in plain Python: counts of hosts, domains and
    suffixes, each smoothed by the level above and less the row's own part,
    and of declared values."""
    n = len(languages)
    own = {i: np.exp(np.array(like) - max(like)) / np.exp(np.array(like) - max(like)).sum() for i, _, like, _, _ in rows}
    part = lambda h: (".".join(h.split(".")[-2:]), h.split(".")[-1] if "." in h else "")
    some = [r for r in rows if r[4]]
    total = lambda rs: sum((own[r[0]] for r in rs), np.zeros(n))
    world = total(some) + 1
    world = world / world.sum()
    smooth = lambda c, up, k: (c + k * up) / (c.sum() + k)
    claim = lambda d: d if d in languages else "?"
    table = np.array([total([r for r in some if r[3] and claim(r[3]) == c]) for c in (*languages, "?")])
    flat = np.full(table.shape, s.declared / (n + 1))
    flat[np.arange(n), np.arange(n)] += s.declared
    told = (table + flat) / (table + flat).sum(axis=0)
    out = {}
    for i, host, _, declared, k in rows:
        place = world
        if host and any(r[1] == host for r in some):
            domain, suffix = part(host)
            up = smooth(total([r for r in some if r[1] and part(r[1])[1] == suffix]), world, s.suffix)
            up = smooth(total([r for r in some if r[1] and part(r[1]) == (domain, suffix)]), up, s.domain)
            mine = own[i] if k else 0
            place = smooth(np.maximum(total([r for r in some if r[1] == host]) - mine, 0), up, s.host)
        joint = own[i] * place * (told[[*languages, "?"].index(claim(declared))] if declared else 1)
        out[i] = languages[int(np.argmax(joint))], joint.max() / joint.sum()
    return out


def test_fusion_against_plain_counting(spark):
    rng = np.random.default_rng(8)
    hosts = ["a.b.c", "x.b.c", "b.c", "q.d", "d", None]
    languages = ("x", "y", "z")
    raw = [
        (i, hosts[rng.integers(6)], rng.normal(0, 3, 3).tolist(), [None, "x", "y", "z", "odd", "xx"][rng.integers(6)], int(rng.integers(0, 4)))
        for i in range(200)
    ]
    rows = spark.createDataFrame(raw, "id long, host string, likelihood array<double>, declared string, n_trigrams long")
    want = plain_fusion(raw, languages, langid.Fusion())
    got = langid.fuse(rows, languages).collect()
    assert len(got) == len(raw)
    for r in got:
        assert r["language"] == want[r["id"]][0] and abs(r["confidence"] - want[r["id"]][1]) < 1e-9
        assert r["accepted"] == (r["n_trigrams"] > 0 and r["confidence"] >= 0.5)


def test_a_text_of_no_modelled_language_is_rejected(spark):
    """One Hungarian text among 150 of two languages."""
    en = "the cat and the dog went with the hat that they have seen on the table of the house {} times and then some more of it was there"
    es = "el gato y el perro fueron con los sombreros que ellos han visto en la mesa de la casa {} veces y luego otras cosas estaban tambien"
    hu = "a magyar nyelv egyik legnagyobb erteke hogy szavaink tobbsegukben osi eredetuek es minden gyermek konnyen megtanulhatja oket otthon a szuleitol"
    rows = [(i, (en if i % 2 else es).format(i), "en" if i % 2 else "es", "s") for i in range(150)] + [(150, f"{hu} {hu}", "hu", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in langid.identify_documents(docs).collect()}
    assert not got[150]["accepted"] and got[150]["language"] is None
    assert sum(got[i]["accepted"] for i in range(150)) >= 149


def test_odd_rows(spark, odd_documents, no_documents):
    kept = langid.accepted_documents(odd_documents)
    assert kept.schema == odd_documents.schema
    assert {r["doc_id"] for r in kept.collect()} >= {1, 5, 6} and not {2, 3, 4} & {r["doc_id"] for r in kept.collect()}
    every = {r["doc_id"]: r for r in langid.identify_documents(odd_documents).collect()}
    assert not every[2]["accepted"] and every[2]["text_language"] is None and every[1]["language"] == "en"
    assert langid.accepted_documents(no_documents).count() == 0 and langid.identify_documents(no_documents).count() == 0
    assert langid.identify_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def _sentences(letters, n):
    rng = np.random.default_rng([ord(x) for x in letters])
    words = ["".join(rng.choice(list(letters), rng.integers(2, 7))) for _ in range(80)]
    return [" ".join(rng.choice(words, 25)) for _ in range(n)]


def test_rare_and_foreign_languages(spark):
    """A language of 0.6% of the rows is one; texts of none are rejected."""
    common, rare, none = _sentences("abcdefgh", 9940), _sentences("ijklmnop", 60), _sentences("qrstuvwx", 40)
    rows = [(x, "en") for x in common] + [(x, "gd") for x in rare] + [(x, "zz") for x in none[:20]] + [(x, "en") for x in none[20:]]
    docs = spark.createDataFrame([(i, x, d, "s") for i, (x, d) in enumerate(rows)], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in langid.identify_documents(docs).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["language"] == "gd" and got[i]["accepted"] for i in range(9940, 10_000))
    assert not any(got[i]["accepted"] or got[i]["language"] for i in range(10_000, 10_040))
    assert sum(got[i]["accepted"] and got[i]["language"] == "en" for i in range(9940)) >= 0.999 * 9940
