"""The ten operators against brute force, round trips and held-out accuracy, with nulls, empty texts, ties and empty tables."""

import random
import re
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.llm import chat_template as C
from quillspan.llm import decontamination as D
from quillspan.llm import embedding_caps as E
from quillspan.llm import jaccard_join as J
from quillspan.llm import language_id as L
from quillspan.llm import mixing as M
from quillspan.llm import pii_surrogates as P
from quillspan.llm import rule_ensemble as R
from quillspan.llm import token_binary as B
from quillspan.llm import runs as R2
from quillspan.llm import token_counts as T
from quillspan.llm.vocabulary import PATTERN, encoder_of, read_vocabulary

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, __n string"


def docs_of(spark, texts, langs=None):
    return spark.createDataFrame([(None if i == 97 else i, t, langs[i] if langs else "en", f"s{i % 3}", None, "x") for i, t in enumerate(texts)], DOCS)


ODD = [None, "", "   ", "!!!", "word", "word", "😀 ünï 数字 123", "a" * 70_000]


def test_surrogates_hide_keep_format_and_corefer(spark):
    text = "Mrs Anna Kowalski (anna.k@corp.example.com, +1 (974) 555-3436, 4111 1111 1111 1111, 10.0.0.7). Kowalski: ANNA.K@corp.example.com"
    got = {r.doc_id: r for r in P.with_surrogates(docs_of(spark, [*ODD, text, text.replace("555-3436", "555-3437")]), b"key").collect()}
    a, b = got[8].text, got[9].text
    for secret in ("Kowalski", "anna.k", "555-3436", "4111 1111", "10.0.0.7"):
        assert secret.lower() not in a.lower()
    assert got[8].n_entities == 8 and got[0].text is None and got[1].text == "" and got[4].text == "word" and got[4].n_entities == 0
    mails = re.findall(r"[\w.]+@[\w.]+", a)
    assert mails[0] == mails[1].lower() and P.luhn_valid(re.sub(r"\D", "", re.search(r"\d{4} \d{4} \d{4} \d{4}", a)[0]))
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", a)[0] != re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", b)[0]
    assert P.with_surrogates(docs_of(spark, []), b"key").count() == 0
    with pytest.raises(ValueError):
        P.with_surrogates(docs_of(spark, []), b"")


def surrogated(text, key=b"key"):
    return P.replaced(text, None, key, P.surrogate)[0]


@pytest.mark.parametrize(
    "text, secrets",
    [
        ("Mr Aldo Bruno Cesar Dominguez came. Later Dominguez left.", ["Aldo", "Bruno", "Cesar", "Dominguez"]),
        ("Name: Juan Carlos Pérez García", ["Juan", "Carlos", "Pérez", "García"]),
        ("Dr. J. Smith met Herr von Braun and Herr Ludwig van Beethoven", ["J.", "Smith", "Braun", "Ludwig", "Beethoven"]),
        (f"write to {'q' * 80}@mail.org now", ["q" * 8]),
        (f"write to a@{'q' * 80}.org now", ["q" * 8]),
        ("姓名：王小明。王小明说", ["王小明", "小明"]),
        ("Όνομα: Γιώργος Παπαδόπουλος", ["Γιώργος", "Παπαδόπουλος"]),
    ],
)
def test_surrogates_leave_nothing_of_long_or_rare_forms(text, secrets):
    out = surrogated(text)
    assert not [x for x in secrets if x in out] and len(out.split()) == len(text.split())


def test_surrogates_of_one_number_in_two_forms_and_of_long_keys():
    one, two = re.findall(r"\(?\d{3}\)? ?\d{3}-\d{4}", surrogated("+1 (974) 555-3436 or (974) 555-3436"))
    assert one == two
    assert surrogated("10.0.0.7", b"k" * 64 + b"a") != surrogated("10.0.0.7", b"k" * 64 + b"b")


def test_surrogates_as_assigned_by_brute_force(spark):
    names = [f"email:{a}{b}@{c}{d}.org" for a in "abc" for b in "de" for c in "abcdefghijklm" for d in "nopqrstuvwxyz"] + [f"ssn:{i * 7:09d}" for i in range(200)] + [f"given:{a}{b}|f" for a in "abcdefgh" for b in "xyz"]

    def settled(entities, domain_of):
        left, taken, real = sorted(entities), {}, set(entities)
        for attempt in range(P.MOST_DRAWS):
            drawn = {}
            for e in left:
                kind, _, canon = e.partition(":")
                s = f"{kind}:{P.surrogate(kind, canon, attempt, b'key', domain_of(e))}"
                if s not in real and s not in taken.values():
                    drawn.setdefault(s, e)
            taken |= {e: s for s, e in drawn.items()}
            left = [e for e in left if e not in taken]
        assert not left
        return taken

    domains = settled({f"domain:{n.split('@')[1]}" for n in names if "@" in n}, lambda e: None)
    first = {e: f"domain:{P.surrogate('domain', e[7:], 0, b'key')}" == s for e, s in domains.items()}
    of = lambda e: None if "@" not in e or first[f"domain:{e.split('@')[1]}"] else domains[f"domain:{e.split('@')[1]}"][7:]
    want = settled(names, of)
    got = {r.entity: r.surrogate for r in P.assigned(spark.createDataFrame([(n,) for n in names], "entity string"), b"key").collect()}
    assert got == want and not all(first.values()) and len(set(domains.values())) == 169


def test_surrogates_of_a_crowded_space(spark, monkeypatch):
    monkeypatch.setattr(P, "MOST_DRAWS", 2)
    names = [f"ipv4:192.168.{i}.{j}" for i in range(160) for j in range(256)]
    got = P.assigned(spark.createDataFrame([(n,) for n in names], "entity string"), b"key").collect()
    drawn = [r.surrogate for r in got]
    assert len(got) == len(set(drawn)) == len(names) and all(d.startswith("ipv4:192.168.") for d in drawn)
    assert len(set(drawn) & set(names)) == 2 * len(names) - 65536  # no more than there must be


def test_surrogates_are_distinct_and_no_entities(spark, monkeypatch):
    names = [f"email:{c}@d.org" for c in "abcdefghijklmnopqrstuvwxyz"] + [f"ssn:{i:09d}" for i in range(300)]
    got = P.assigned(spark.createDataFrame([(n,) for n in names], "entity string"), b"key").collect()
    drawn = [r.surrogate for r in got]
    assert len(got) == len(names) == len(set(drawn)) and not set(drawn) & set(names) and not all(r.first for r in got)


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.fit(docs.where("doc_id % 2 = 0"), sample_docs=200)
    got = L.identified(docs.where("doc_id % 2 = 1"), model).select("lang", "language_id.*").toPandas()
    assert (got["lang"] == got["language"]).mean() > 0.95 and got["accepted"].mean() > 0.97
    odd = {r.doc_id: r.language_id for r in L.identified(docs_of(spark, [*ODD, "zqx " * 200]), model).collect()}
    assert not odd[0].accepted and odd[1].language is None and not odd[8].accepted
    none = L.fit(docs_of(spark, []))
    assert not any(r.language_id.accepted for r in L.identified(docs_of(spark, ["a b"]), none).collect())


def test_language_limits_withstand_mislabelled_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {k: [r.text for r in docs.where(F.col("lang") == k).orderBy("doc_id").limit(150).collect()] for k in ("de", "en")}
    model = L.fit(docs_of(spark, [*texts["de"], *texts["en"]], ["de"] * len(texts["de"]) + ["en"] * len(texts["en"])))
    held = [t for t in texts["de"] if t][1::2]
    clean = L.calibrate(model, ["de"] * len(held), held)[0]
    assert np.allclose(L.calibrate(model, ["de"] * (len(held) + 6), held + texts["en"][:6])[0], clean) and clean[3] < 15


def test_languages_beyond_one_pass(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = ["doc_id", "language_id.language", "language_id.accepted", F.round("language_id.cross_entropy", 9), F.round("language_id.margin", 9)]
    whole = L.fit(docs, sample_docs=60)
    want = sorted(L.identified(docs, replace(whole, limits=np.tile([0, 1, 0, np.inf], (4, 1)))).select(columns).collect())
    monkeypatch.setattr(L, "MOST_LANGUAGES", 1)
    parts = L.fit(docs, sample_docs=60)
    assert [parts.languages, *(p.languages for p in parts.more)] == [[x] for x in whole.languages]
    for p in (parts, *parts.more):
        p.limits[:] = (0, 1, 0, np.inf)
    assert len(want) and sorted(L.identified(docs, parts).select(columns).collect()) == want


def test_kneser_ney_sums_to_one():
    codes, at = L._prepared(["abab abc abba cab"], 3)
    grams = np.lib.stride_tricks.sliding_window_view(codes, 3)
    distinct, n = np.unique(grams, axis=0, return_counts=True)
    fitted = L.fit_language(distinct, n, 3)
    model = L.Model(["x"], 3, [fitted[0]], [fitted[1]], [fitted[2]])
    signs = np.unique(grams[:, 2])
    tries = np.concatenate([[ord("a"), ord("b"), s] for s in signs]).astype(np.uint32)
    p = np.exp(model.log_probabilities(tries, np.arange(2, len(tries), 3)))[:, 0]
    unseen = np.exp(model.log_probabilities(np.array([ord("a"), ord("b"), ord("q")], np.uint32), np.array([2])))[0, 0]
    assert p.sum() + unseen == pytest.approx(1.0, abs=1e-6)


def test_templates():
    run = C.compiled(C.CHATML)
    text, spans = run([{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yö"}])
    assert text == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyö<|im_end|>\n" and [text[a:b] for a, b in spans] == ["yö<|im_end|>"]
    show = lambda t, m=None, **v: C.compiled(t)(m or [], **v)[0]
    assert show("{% for m in messages if m.role != 'x' %}{{ loop.index }}{{ m.content | trim | upper }}{% if not loop.last %},{% endif %}{% else %}none{% endfor %}") == "none"
    assert show("{% set a = [1, 2, 3] %}{{ a[1:] | length }}{{ a[-1] + 2 * 3 }}{{ 'y' if x is defined else 'n' }}{{ {'k': 'v'}.k ~ 1 }}") == "29nv1"
    assert C.fold(C.parse("{{ 'a' ~ 1 + 2 }}b{% if false %}c{% endif %}{{ x }}")) == [("text", "a3b"), ("print", ("var", "x"))]
    for bad in ("{{ x.__class__.__mro__ }}", "{{ messages.append }}"):
        assert show(bad) == ""
    talk = [{"role": "user", "content": " hi "}, {"role": "assistant", "content": "<think>x</think> yö"}]
    assert show("{{ messages[1].content.split('</think>')[-1].lstrip() }}|{{ messages[0].content.strip().startswith('h') }}|{{ {'a': 1}.get('b', 2) }}", talk) == "yö|True|2"
    assert show("{% set ns = namespace(n=0) %}{% for m in messages %}{% set ns.n = ns.n + 1 %}{% endfor %}{{ ns.n }}", talk) == "2"
    assert show("{% macro f(a, b='x') %}[{{ a }}{{ b }}]{% endmacro %}{{ f(1) }}{{ f(2, b='y') }}") == "[1x][2y]"
    assert show("{% for i in range(9) %}{% if i == 1 %}{% continue %}{% endif %}{% if i == 4 %}{% break %}{% endif %}{{ i }}{% endfor %}") == "023"
    assert show("{{ messages | selectattr('role', 'equalto', 'user') | map(attribute='content') | join(',') }}{% set a %}q{{ 1 }}{% endset %}{{ a }}", talk) == " hi q1"
    assert C.compiled("  {% if true %}\n a\n  {% endif %}\nb", True, True)([])[0] == " a\nb"
    for bad in ("{% set a = 'x' %}" + "{% set a = a ~ a %}" * 40, "{% set a = [1] %}" + "{% set a = [a, a] %}" * 60 + "{{ a }}", "{{ " + "not " * 3000 + "x }}", "{{ " + "-" * 3000 + "1 }}", "{{ 1" + "+1" * 3000 + "}}",
                "{% macro f(n) %}{{ f(n) }}{% endmacro %}{{ f(1) }}", "{{ 9223372036854775807 * 2 }}", "{{ 'a'.format(1) }}", "{% break %}", "{{ range(9000000000) }}", "{% set a = 'x' * 3 %}", "{% for i in range(9999999) %}{% for j in range(99) %}{% endfor %}{% endfor %}"):
        with pytest.raises(C.TemplateError):
            show(bad)
    for bad in ("{% import os %}", "{{ open('f') }}", "{{ x | nothing }}", "{% if a %}", "{{ 'a' * 9 }}"):
        with pytest.raises(C.TemplateError):
            show(bad)


def test_chat_rows(spark):
    rows = [(1, 2, "assistant", None), (1, 1, None, "q"), (None, 1, "user", "lost"), (2, None, "user", ""), (2, None, "user", "")]
    got = {r.conv_id: r for r in C.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {1, 2} and got[1].rendered.startswith("<|im_start|>\nq<|im_end|>") and got[2].n_turns == 2
    assert C.formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    failed = C.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), "{{ raise_exception('no') }}").first()
    assert failed.rendered is None and failed.error == "no"


def test_token_records_round_trip(spark):
    texts = [*ODD, *[f"the quick brown fox {i} " * (i % 9 + 1) for i in range(60)]]
    rows = B.token_binary(docs_of(spark, texts)).collect()
    head = next(r for r in rows if r.shard == -1)
    encode = encoder_of(read_vocabulary(), PATTERN).encode_ordinary
    for r in rows:
        if r.shard >= 0 and r.n_tokens is not None:
            ids = B.read_record(bytes(r.payload), bytes(head.payload), r.dict_hash)
            assert ids.tolist() == encode(texts[r.doc_id]) and len(ids) == r.n_tokens
    assert len(rows) == len(texts) + 1 and [r for r in rows if r.doc_id == 0][0].n_tokens is None
    for shard in {r.shard for r in rows if r.shard >= 0}:
        mine = sorted((r for r in rows if r.shard == shard), key=lambda r: r.offset)
        assert all(a.offset + a.n_bytes == b.offset or a.n_bytes == 0 for a, b in zip(mine, mine[1:]))
    assert B.token_binary(docs_of(spark, [])).count() == 1


def test_token_records_are_read_by_offset(spark, tmp_path):
    texts = [*ODD, *[f"the quick brown fox {i} " * (i % 9 + 1) for i in range(60)]]
    docs = docs_of(spark, texts).repartition(3).withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id")))
    path = f"{tmp_path}/shards"
    index = B.write_shards(B.token_binary(docs), path)
    rows = index.collect()
    encode = encoder_of(read_vocabulary(), PATTERN).encode_ordinary
    assert len(rows) == len(texts) + 1 and len({r.file for r in rows}) > 2
    for r in rows:
        if r.shard >= 0 and r.n_tokens is not None:
            head = next(x for x in rows if x.shard == -1)
            ids = B.read_record(B.read_bytes(path, r.file, r.offset, r.n_bytes), B.read_bytes(path, head.file, head.offset, head.n_bytes), r.dict_hash)
            assert ids.tolist() == encode(texts[int(r.doc_id[1:])])
    assert B.read_document(index, path, "d12").tolist() == encode(texts[12]) and B.read_document(index, path, "none") is None
    names = {r.file for r in rows}
    assert {f.name for f in (tmp_path / "shards").iterdir() if f.name.startswith("shard-")} == names


def test_token_counts_are_the_vocabularys(spark):
    texts = [*ODD, "don't  stop\n\n now…", "x" * 300]
    encode = encoder_of(read_vocabulary(), PATTERN).encode_ordinary
    got = {r.doc_id: r.n_tokens for r in T.token_counts(docs_of(spark, texts)).collect()}
    assert got == {i: None if t is None else len(encode(t)) for i, t in enumerate(texts)}
    assert T.token_counts(docs_of(spark, [])).count() == 0


def near_texts():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(400)]
    out = []
    for n in (3, 12, 40, 150, 600):
        for _ in range(12):
            base = rng.choices(words, k=n)
            out.append(" ".join(base))
            for cut in (0, 1, 2, 5):
                other = base[:]
                for _ in range(min(cut, n // 6)):
                    other[rng.randrange(n)] = rng.choice(words)
                out.append(" ".join(other))
    return out


def brute(texts, gamma=J.GAMMA):
    def grams(t):
        w = re.findall(r"\w+", (t or "").lower())
        return {tuple(w[i : i + 2]) for i in range(max(1, len(w) - 1))} if w else set()

    g = [grams(t) for t in texts]
    return {(i, j) for i in range(len(g)) for j in range(i + 1, len(g)) if g[i] and len(g[i] & g[j]) >= gamma * len(g[i] | g[j])}


def classes_of(n, pairs):
    """By document: (least of those joined to it, number of links)."""
    beside = {i: set() for i in range(n)}
    for i, j in pairs:
        beside[i].add(j)
        beside[j].add(i)
    out = {}
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            todo += [k for k in beside[todo.pop()] if k not in seen and not seen.add(k)]
        out[i] = min(seen), len(beside[i])
    return out


def test_jaccard_join(spark, monkeypatch):
    texts = [*ODD[:6], *near_texts()]
    docs = docs_of(spark, texts)
    want = classes_of(len(texts), {p for p in brute(texts) if 97 not in p})
    del want[97]  # it has no id
    members, similar = J.similar_sets(docs)
    got = {r.doc_id: (r.class_id, r.n_links) for r in J.jaccard_join(docs).collect()}
    assert set(got) == set(want) and got[4] == got[5] == (4, 1) and got[1] == (1, 0)
    assert sum(n for _, n in got.values()) >= 0.97 * sum(n for _, n in want.values()) and all(got[i][1] <= want[i][1] for i in got)
    assert sum(got[i][0] == want[i][0] for i in got) >= 0.98 * len(got)
    assert J.jaccard_join(docs_of(spark, [])).count() == 0
    kept = {r.doc_id for r in J.without_near_copies(docs).collect()}
    assert kept - {None} == {c for c, _ in got.values()} and None in kept
    # long runs and heavy groups, divided, give the same
    monkeypatch.setattr(R2, "RUN", 3)
    monkeypatch.setattr(R2.paired, "__defaults__", (R2.all_pairs, None, 3, 400))
    monkeypatch.setattr(J, "BUCKET_PAIRS", 5)
    again = {r.doc_id: (r.class_id, r.n_links) for r in J.jaccard_join(docs).collect()}
    assert again == got


def test_spherical_caps(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((300, 32))
    u = base / np.linalg.norm(base, axis=1)[:, None]
    w = rng.standard_normal(u.shape)
    w -= (w * u).sum(1)[:, None] * u
    x = np.vstack([u, 0.91 * u + np.sqrt(1 - 0.91**2) * w / np.linalg.norm(w, axis=1)[:, None], u[:60] * 3 + 0.001 * rng.standard_normal((60, 32))]).astype(np.float32)
    odd = [(900, None, 0), (901, [], 0), (902, [0.0] * 32, 0), (903, [float("nan")] * 32, 0), (904, x[5].tolist(), 0), (905, [1.0, 2.0], 0), (906, [1.0] * 31 + [None], 0), (None, x[0].tolist(), 0), (904, x[5].tolist(), 0)]
    schema = "vec_id long, embedding array<float>, label int"
    rows = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)] + odd, schema)
    n = x / np.linalg.norm(x, axis=1)[:, None]
    a, b = np.nonzero(np.triu(n @ n.T >= 0.9, 1))
    pairs = set(zip(a.tolist(), b.tolist()))
    pairs |= {(i, 660) for i in range(660) if n[5] @ n[i] >= 0.9}  # 660 stands for id 904
    want = {(904 if i == 660 else i): v for i, v in classes_of(661, pairs).items()}
    got = {r.vec_id: (r.class_id, r.n_links) for r in E.similar_vectors(rows).collect()}
    assert {i: got[i] for i in (900, 901, 902, 903, 905, 906)} == {i: (i, 0) for i in (900, 901, 902, 903, 905, 906)} and None not in got
    assert set(got) == set(want) | {900, 901, 902, 903, 905, 906} and sum(v[1] for i, v in got.items()) >= 0.95 * sum(v[1] for v in want.values()) and got[904][0] == 5
    assert all(got[i][1] <= want[i][1] for i in want)
    assert E.similar_vectors(spark.createDataFrame([], schema)).count() == 0
    monkeypatch.setattr(E, "RUN", 5)
    monkeypatch.setattr(R2.paired, "__defaults__", (R2.all_pairs, None, 5, 3000))
    assert {r.vec_id: (r.class_id, r.n_links) for r in E.similar_vectors(rows).collect()} == got


def edits_within(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return min(row)


def test_decontamination_by_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    phrase = lambda n: " ".join("".join(rng.choices("abcdefg", k=rng.randint(2, 7))) for _ in range(n))
    items = [phrase(14) for _ in range(5)] + ["short", None, "", "Ab, c", "!?"]
    texts = [*ODD[:6], "a short one", "too shorty", "shortish", "ab c", "xab c", "ab cd", "Short", "(ab) c!"]
    for i in range(40):
        item = list(items[i % 5])
        for _ in range(i // 4):
            item[rng.randrange(len(item))] = rng.choice("xyz")
        texts.append(f"{phrase(20)} {''.join(item)} {phrase(20)}" if i % 8 else phrase(60))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    plain = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    near = lambda item, t: edits_within(item, t) <= D.budget(len(item)) if len(item) >= D.Q else f" {item} " in f" {t} "
    want = {(d, i) for d, t in enumerate(texts) for i, item in enumerate(items) if t and item and plain(item) and near(plain(item), plain(t))}
    got = {(r.doc_id, r.item_id) for r in D.contaminated(docs_of(spark, texts), bench).collect()}
    assert got == want and len(want) > 9 and (6, 5) in got and (9, 8) in got
    clean = {r.doc_id for r in D.without_contamination(docs_of(spark, texts), bench).collect()}
    assert clean == set(range(len(texts))) - {d for d, _ in want}
    assert D.without_contamination(docs_of(spark, texts), bench.where("item_id > 99")).count() == len(texts)
    monkeypatch.setattr(D, "MOST_PAIRS", 5)  # by diagonals, the same
    index = D.build_index(D.pa.array(range(len(items))), items)
    assert {(d, i) for d, i, _ in D.Searcher(index).matches(texts)} == want
    named = D.contaminated(docs_of(spark, texts).withColumn("doc_id", F.concat(F.lit("d"), "doc_id")), bench.withColumn("item_id", F.concat(F.lit("i"), "item_id")))
    assert {(r.doc_id, r.item_id) for r in named.collect()} == {(f"d{d}", f"i{i}") for d, i in want}


def tilts_by_bisection(t, source, goal):
    """Rates of documents of t tokens: b by halving, each source's number in closed form."""
    z = np.log(t)
    mean = (t * z).sum() / t.sum()
    z = (z - mean) / np.sqrt((t * z * z).sum() / t.sum() - mean**2)

    def rates(b):
        w = np.zeros(len(t))
        for s, g in goal.items():
            own = source == s
            e = np.exp(b * z[own])
            w[own] = e * g / (t[own] * e).sum()
        return w

    low, high = -20.0, 20.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if (rates(middle) * t * z).sum() < 0 else (low, middle)
    return rates(low)


def test_mixing_reaches_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rated = M.mixed_rates(docs, targets={"src0": 1.0, "src1": 3.0}).toPandas()
    rated["w"] = rated["rate"] * rated["n_tokens"]
    by = rated.groupby("source")["w"].sum()
    whole = rated["n_tokens"].sum()
    assert by["src1"] == pytest.approx(3 * by["src0"], rel=1e-6) and by.sum() == pytest.approx(whole, rel=1e-6) and by["src2"] == 0 and rated["lengths_met"].all()
    some = rated[rated["n_tokens"] > 0]
    alone = tilts_by_bisection(some["n_tokens"].to_numpy(float), some["source"].to_numpy(), {"src0": whole / 4, "src1": 3 * whole / 4})
    assert np.allclose(alone, some["rate"], rtol=1e-5, atol=1e-9)
    counted = {r.doc_id: r.n_tokens for r in T.token_counts(docs).collect()}
    assert counted == {r.doc_id: r.n_tokens for r in rated.itertuples()}
    by_default = M.mixed_rates(docs, keep=["doc_id", "source"]).toPandas()
    totals = by_default.groupby("source")["n_tokens"].sum().astype(float)
    goal = totals**M.TEMPERATURE * totals.sum() / (totals**M.TEMPERATURE).sum()
    assert np.allclose(by_default.assign(w=by_default.rate * by_default.n_tokens).groupby("source")["w"].sum(), goal, rtol=1e-6)


def test_mixing_where_lengths_cannot_be_met(spark):
    docs = spark.createDataFrame([(1, "a b c", "x"), (2, "a " * 50, "y"), (3, None, None), (4, "", "x")], "doc_id long, text string, source string")
    with pytest.warns(UserWarning):
        got = {r.doc_id: r for r in M.mixed_rates(docs).collect()}
    assert not got[1].lengths_met and got[3].rate == got[4].rate == 1.0 and got[3].copies == 1
    assert got[1].rate * got[1].n_tokens / (got[2].rate * got[2].n_tokens) == pytest.approx((got[1].n_tokens / got[2].n_tokens) ** M.TEMPERATURE)


def test_rules_score_alike_in_spark_and_numpy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = R.train(docs, labels.where("doc_id % 3 > 0"))
    assert 0 < len(model.rules) < 80
    got = R.with_quality(docs, model).join(labels.where("doc_id % 3 = 0"), "doc_id").toPandas()
    assert ((got["quality_score"] >= 0.5) == (got["quality"] == 1)).mean() > 0.95 and got.loc[got["quality"] == 1, "keep"].mean() > 0.97
    x, _ = R.labelled_statistics(docs, labels.where("doc_id % 3 = 0"))
    assert np.allclose(np.sort(model.scores(x)), np.sort(got["quality_score"]))
    odd = {r.doc_id: r for r in R.with_quality(docs_of(spark, ODD), model).collect()}
    assert odd[0].quality_score is None and odd[0].keep is False and odd[1].quality_score is not None
    assert R.train(docs, labels.where("false")).constant == 1.0 and R.with_quality(docs_of(spark, []), model).count() == 0
