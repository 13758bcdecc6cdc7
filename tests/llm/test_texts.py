"""Language, decontamination, pages, scoring and secrets against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from schemaloom.llm import decontaminate, language, pages, pitman_yor, queries, secrets

FOLDER = "/root/testdata/sf0.001"


# --- language -------------------------------------------------------------------
def segmentations(raw):
    if not raw:
        yield []
    for n in range(1, len(raw) + 1):
        for rest in segmentations(raw[n:]):
            yield [raw[:n], *rest]


def test_forward_sums_all_segmentations():
    lattice = language.Lattice(language.VOCABULARY)
    tokens = language.load_tokens(language.VOCABULARY)
    ids = {t: i for i, t in enumerate(tokens) if len(t) <= language.LONGEST_PIECE}
    rng = np.random.default_rng(1)
    probs = np.vstack([rng.random((lattice.size, 3)) * 1e-2, np.zeros((1, 3))])
    words = ["a", "the", "über", "ñandú"]
    got = np.exp(language.log_probabilities(lattice, words, probs))
    for w, row in zip(words, got):
        want = sum(np.prod([probs[ids[p]] for p in s], axis=0) for s in segmentations(b" " + w.encode()) if all(p in ids for p in s))
        assert np.allclose(row, want)
    edges, lengths = lattice.edges([b" the", b" a"])
    a, b = language.forward(edges, lengths, probs), language.backward(edges, lengths, probs)
    assert np.allclose(a[[0, 1], lengths], b[:, 0])


def test_held_out_accuracy(spark):
    rows = queries.QUERIES["op1_language_id"](spark, FOLDER).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "", None), (5, "12 34 !?", "de"),
            (6, "und die katze", None), (None, "the dog " * 20_000, None), (8, "x" * 500, None)]
    docs = spark.createDataFrame([(i, t, k, "old") for i, t, k in rows], "doc_id long, text string, lang string, score string")
    model = language.fit(docs)
    assert model.labels == ["de", "en"] and np.allclose(model.probs.sum(axis=0), 1)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(docs, model).collect()}
    assert [got[i] for i in (3, 4, 5)] == [("und", 0.0)] * 3
    assert [got[i][0] for i in (1, 2, 6, None)] == ["en", "de", "de", "en"]
    none = language.fit(docs.where("doc_id = 4"))
    assert {r["lang_pred"] for r in language.predict(docs, none).collect()} == {"und"}
    assert language.predict(docs.limit(0), model).count() == 0


# --- decontamination --------------------------------------------------------------
QUESTION = ("A train leaves the northern station at 9 and travels 120 km before Maria boards it in the small town. "
            "How many km must Maria still ride if the whole line is 300 km long and she leaves it at the end?")


def replaced(text, values):
    for a, b in values.items():
        text = re.sub(rf"\b{a}\b", b, text)
    return text


@pytest.fixture(scope="module")
def leaks(spark):
    fill = "Some other words stand here to fill the page with plain text of no interest to anybody. "
    texts = [
        fill + QUESTION + " " + fill, QUESTION.upper(), replaced(QUESTION, {"Maria": "Anton", "120": "75", "300": "999"}),
        replaced(QUESTION, {"120": "300"}),  # one value stands for two of the item's
        re.sub(r"Maria still", "Anton still", QUESTION), fill, None, "", "9 120 km 300", fill * 2000 + QUESTION, QUESTION,
    ]
    docs = spark.createDataFrame([(i if i != 9 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(7, QUESTION, 1), (7, QUESTION, 1), (8, None, 1), (None, fill, 1), (9, "", 1), (10, "too short", 1)], "item_id long, text string, a int")
    return docs, bench


def test_copied_and_changed_questions(leaks):
    docs, bench = leaks
    got = {r["doc_id"]: r for r in decontaminate.matches(docs.drop("item_id"), bench).collect()}
    assert {0, 1, 2, 10, None} <= set(got) and not {5, 6, 7, 8} & set(got)
    assert got[0]["n_windows"] == got[0]["item_windows"] and got[0]["n_changed"] == 0
    assert got[2]["n_changed"] >= 3
    for odd in (3, 4):  # only the part without the contradiction is left, if any
        assert odd not in got or got[odd]["n_windows"] < got[0]["n_windows"]


def test_contradiction_keeps_the_other_windows(spark):
    same = " the old mill by the river grinds corn for all the people of the quiet valley in the long and cold winter "
    item = "A miller has 5 sacks and then buys 5 others at the market," + same + "until 3 men ask for 7 loaves of fresh bread"
    rows = [(1, item.replace("buys 5", "buys 7")), (2, item.replace(" 3 ", " 4 ").replace(" 7 ", " 4 ")), (3, item), (4, item.replace("5", "6"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, "Tell me how 3 dogs and 5 cats share one house")], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.matches(docs, bench).collect()}
    assert set(got) == {1, 2, 3, 4}
    assert 0 < got[1]["n_windows"] < got[3]["n_windows"] == got[3]["item_windows"]
    assert got[2]["n_windows"] == got[4]["n_windows"] == got[3]["n_windows"]
    equal = spark.createDataFrame([(1, "Tell me how 4 dogs and 4 cats share one house"), (2, "Tell me how 3 dogs and 5 bats share one house")], "doc_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.matches(equal, bench).collect()] == [(1, 2)]
    assert decontaminate.remove_contaminated(docs, bench).count() == 0


def test_items_of_few_plain_words(spark):
    numbers = "Continue: 1 4 9 16 25 36 49 64 81 100 121 144 169 196 225"
    items = ["What is 12 * (3 + 4) / 2?", numbers, "Maria has 5 red apples and eats 2 of them", "Define entropy", "Seven"]
    fill = " Some other words stand here. "
    texts = [fill + items[0] + fill, fill + numbers + fill, "Anton has 5 red apples and eats 2 of them", "so Anton has 6 red apples and eats 2 of them",
             "please DEFINE ENTROPY, define entropy " * 9, "What is 13 * (3 + 4) / 2?", numbers.replace("1 4 9 16 25", "2 3 5 8 13"), fill,
             "In 5 hours pass the salt to him and her", "It took 3. What is 12 * (3 + 4) / 2", "seventh", numbers.replace("64", "65")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([*enumerate(items), (5, "Hours pass the salt to him and her")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, bench).collect()}
    assert got == {(0, 0), (1, 1), (2, 2), (3, 2), (4, 3), (8, 5), (9, 0)}


def test_removal_keeps_clean_rows(leaks):
    docs, bench = leaks
    kept = decontaminate.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert {5, 6, 7, 8} <= {r["doc_id"] for r in kept.collect()}
    assert not {0, 1, 2, 10} & {r["doc_id"] for r in kept.collect()}
    assert decontaminate.remove_contaminated(docs.limit(0), bench).count() == 0
    assert decontaminate.remove_contaminated(docs, bench.limit(0)).count() == docs.count()


def test_every_contained_item_is_found(spark):
    plain = lambda t: " ".join(t.lower().split())
    docs = [(r["doc_id"], plain(r["text"])) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    items = [(r["item_id"], plain(r["text"])) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    want = {(d, i) for d, t in docs for i, b in items if b in t}
    got = {(r["doc_id"], r["item_id"]) for r in queries.QUERIES["op4_decontamination"](spark, FOLDER).collect()}
    assert want and got == want


# --- pages --------------------------------------------------------------------------
def test_messages_equal_enumeration():
    rng = random.Random(2)
    own: dict = {}
    for _ in range(50):
        p = pages.parse(pages.generated_page(rng))
        pages.count_page(p, pages.labels_by_mark(p), own)
    model = pages.model_of(own)
    page = pages.parse("<body><nav><a href='#'>x y</a></nav><div class='content'><p>One. Two, three.</p><p>Four.</p></div></body>")
    n = len(page.tag)
    total, content = 0.0, np.zeros(n)
    values = pages.traits(page)
    for state in np.ndindex(*[pages.STATES] * n):
        log = model.root[state[0]] + sum(model.step[state[q], s] for q, s in zip(page.parent[1:], state[1:]))
        log += sum(model.seen[t, v][s] for vs, s in zip(values, state) for t, v in zip(pages.TRAITS, vs) if (t, v) in model.seen)
        total += math.exp(log)
        content += math.exp(log) * (np.array(state) == pages.CONTENT)
    assert np.allclose(pages.marginals([page], model)[0], content / total)


def test_held_out_generated_pages(spark):
    model = pages.fit(spark.createDataFrame([], "html string"))
    rng, right, wrong = random.Random(99), 0, 0
    for _ in range(100):
        page = pages.parse(pages.generated_page(rng))
        states = pages.labels_by_mark(page)
        for (node, *_), m in ((r, pages.marginals([page], model)[0]) for r in page.runs):
            right += (states[node] == pages.CONTENT) == (m[node] >= 0.5)
            wrong += (states[node] == pages.CONTENT) != (m[node] >= 0.5)
    assert right / (right + wrong) > 0.93


def test_text_of_every_page(spark):
    """The pages mark their article; the text is what its blocks hold."""
    import html

    rows = {r["page_id"]: r for r in queries.QUERIES["op7_html_extraction"](spark, FOLDER).collect()}
    for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect():
        article = r["html"].split("<article>")[1].split("</article>")[0]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        want = "\n".join(b for b in blocks if b)
        assert rows[r["page_id"]]["text"] == want and rows[r["page_id"]]["n_chars"] == len(want)


@pytest.mark.parametrize("source", [
    "<html><head><title>No</title><meta charset=utf-8><body><article><p>Real text.</p></article>",
    "<head><link rel=x><p>Real text.</p>",
    "<head><script>for(i=0;i<n;i++){ /* don't */ }</script></head><body><article><p>Real text.</p><p class=\"it's\"></article>",
    "<body><script>if (a<b && c) x = 'don</script><p>Real text.</p><i title='x'></i>",
    "<div><form><div><p>No<p>No</div><button>No</div><div><p>Real text.</p></div>",
    "<p><form><input></p>No</form></p><p>Real text.</p>",
    "<div><button>No<button>No</button></div><p>Real text.</p>",
    "<ul><li><select><option>No</ul><p>Real text.</p>",
    "<div><svg><style/><svg></svg><title>No</title></svg></div><p>Real text.</p>",
    "<head><style>No</style>Real text.",
    "<div data-y='12.5'><p data-y=''>Real text.</p></div>",
])
def test_skipped_elements_end(source):
    assert [r[1] for r in pages.parse(source).runs] == ["Real text."]
    assert all(m is None for m in pages.parse("<div data-y=1>x</div>", False).mark)


def test_odd_pages(spark):
    story = "<p>" + "A long sentence, with signs, that tells a story. " * 5 + "</p>"
    rows = [None, "", "plain text only", "<div><<p>x", "<article>" + story + "<form><p>" + "Please fill, now. " * 20 + "</p></form></article><script>var a='<p>no</p>'</script>",
            "<main>" + story + "&amp;&eacute;&#65; tail of the story, which goes on, and on.<a hre", story * 3000,
            "<article>" + story + "</article><section id=comments><div class=comment>" + story + "</div></section><aside>" + story + "</aside>"]
    docs = spark.createDataFrame([(i, h, "u") for i, h in enumerate(rows)], "page_id long, html string, text string")
    got = {r["page_id"]: r["text"] for r in pages.extract(docs, pages.fit(docs)).collect()}
    text = " ".join(re.sub("<[^>]*>", " ", story).split())
    assert got[0] == got[1] == "" and got[4] == text and got[7] == text
    assert got[5].startswith(text) and "&éA tail" in got[5] and "<a" not in got[5]
    assert got[6].count("\n") == 2999
    assert pages.extract(docs.limit(0), pages.fit(docs)).count() == 0


# --- scoring ------------------------------------------------------------------------
def tokens(text):
    return [*(text or "").encode().lower().split(), b""]


def test_base_score_and_counts(spark):
    rows = queries.QUERIES["op9_lm_scoring"](spark, FOLDER).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    seen = Counter(t for d, x in docs.items() if zlib.crc32(str(d).encode()) % 5 != 1 for t in tokens(x))
    total = sum(seen.values())
    floor = total + 0.5 * (len(seen) + 1)
    assert len(rows) == len(docs)
    for r in rows:
        own = tokens(docs[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(seen[t] > 0 for t in own), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((seen[t] + 0.5) / floor) for t in own), rel=1e-6)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([("a b a c the a",), ("the a the b " * 50,), (None,), ("d",)], "text string")
    model = pitman_yor.fit(docs)
    p = np.array([r["p"] for r in model.table.collect()])
    assert model.types == 6 and np.allclose(p.sum(axis=0) + model.unknown, 1, atol=1e-4)


@pytest.mark.parametrize("frequent", [0, 3, 1000])
def test_broadcast_and_join_agree(spark, frequent):
    rows = [(1, "a b a c unknown"), (1, "a b a c unknown"), (2, None), (None, "the a"), (3, ""), (4, "the " * 30_000), (1, "other text")]
    docs = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, hash int")
    model = pitman_yor.fit(docs.where("doc_id <> 1"))
    got = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 3)) for r in pitman_yor.score(docs, model, frequent=frequent).collect()), key=str)
    want = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 3)) for r in pitman_yor.score(docs, model, frequent=50).collect()), key=str)
    assert len(got) == len(rows) and [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3:] for g in got], [w[3:] for w in want], rtol=1e-4)
    assert pitman_yor.score(docs.limit(0), model).count() == 0


def test_frequent_words_do_not_depend_on_tasks(spark):
    """Words that are rare in every task but frequent in all count as such."""
    own = lambda p: " ".join(f"{p}x{i} " * 40 for i in range(5000))
    texts = [(p, f"{own(p)} {'everywhere ' * 45}") for p in range(4)]
    docs = spark.createDataFrame(texts, "p int, text string").repartitionByRange(4, "p").select("text")
    assert docs.rdd.getNumPartitions() == 4
    counts = Counter(t for _, x in texts for t in x.encode().split())
    hashes = lambda word: pitman_yor.hash_words(*next((d, o) for _, d, o in pitman_yor.text_slices(pa.array([word]))), lower=True).hashes[0]
    assert counts.most_common(1)[0][0] == b"everywhere"
    assert pitman_yor.frequent_words(docs, 1).tolist() == [hashes("everywhere")]
    assert pitman_yor.frequent_words(docs, 15).tolist() == pitman_yor.frequent_words(docs.coalesce(1), 15).tolist()
    assert len(pitman_yor.frequent_words(docs.limit(0), 15)) == 0


def reference(train, docs):
    """Scores by dictionaries, seated with the draws of the module."""
    hashed = {}

    def pairs(text):
        found = list(pitman_yor._documents(pa.array([text])))[0]
        hashed.update(zip(tokens(text), found[2].tolist()))
        return list(zip(["^", *tokens(text)], tokens(text)))

    uses = Counter(p for t in train for p in pairs(t))
    words = sorted({w for _, w in uses})
    contexts = sorted({c for c, _ in uses}, key=str)
    hashed["^"] = int(pitman_yor.START_HASH)
    of = lambda w: np.array([hashed[w]], np.uint64)
    (d, s), (d0, s0) = pitman_yor.CONTEXT, pitman_yor.PARENT
    tables = dict.fromkeys(uses, 1)
    parent = dict.fromkeys(words, 1)
    seen = []
    sweeps = pitman_yor.BURN_IN + pitman_yor.SAMPLES
    for sweep in range(sweeps):
        seated = Counter()
        for (_, w), t in tables.items():
            seated[w] += t
        if sweep:
            parent = {w: int(pitman_yor.seat(np.array([seated[w]]), np.array([rest]), d0, of(w), 899 + sweep)[0]) for w in words}
        rest = (s0 + d0 * sum(parent.values())) / (len(words) + 1)
        above = {w: (seated[w] - d0 * parent[w] + rest) / (s0 + sum(seated.values())) for w in words}
        held = Counter()
        for (c, _), t in tables.items():
            held[c] += t
        seen.append((tables, held, above, rest / (s0 + sum(seated.values()))))
        tables = {(c, w): int(pitman_yor.seat(np.array([n]), np.array([(s + d * held[c]) * np.float32(above[w])]), d, pitman_yor._pair(of(c), of(w)), sweep)[0]) for (c, w), n in uses.items()}
    seen = seen[pitman_yor.BURN_IN:]
    customers = Counter()
    for (c, _), n in uses.items():
        customers[c] += n
    mean = lambda get: np.mean([get(x) for x in seen])

    def p(c, w):
        p0 = mean(lambda x: x[2].get(w, x[3]))
        own = (uses[c, w] - d * mean(lambda x: x[0][c, w])) if (c, w) in uses else 0
        return own / (s + customers[c]) + (s + d * mean(lambda x: x[1][c])) / (s + customers[c]) * p0

    unseen = b"nowhere"
    for c in [*contexts, unseen]:
        assert sum(p(c, w) for w in words) + p(c, unseen) == pytest.approx(1)
    return [sum(math.log10(p(c, w)) for c, w in pairs(t)) for t in docs]


@pytest.mark.parametrize("frequent", [0, 30, 300_000])
def test_every_word_is_a_context(spark, frequent):
    """Sixty words each have a follower of their own: scores are those of a restaurant for every one of them, on any partitions."""
    rng = np.random.default_rng(7)
    chain = lambda n: " ".join(f"a{i} b{i}" for i in rng.integers(0, 60, n))
    train = [chain(40) for _ in range(30)] + ["", "a1 a1 a1", None, "b2"]
    docs = [chain(20), "a1 b1", "a1 b2", "b1 b2", "new a1 b1 new words", "", None, "a1 b1"]
    want = reference(train, docs)
    assert want[1] > want[2] + 1
    frame = lambda texts, n: spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(n, "doc_id")
    for n in (1, 5):
        model = pitman_yor.fit(frame(train, n))
        found = pitman_yor.score(frame(docs, n), model, frequent=frequent).orderBy("doc_id").collect()
        assert [r["score"] for r in found] == pytest.approx(want, rel=1e-5)


def test_codes_and_places():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 5, 1000):
        keys = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        asked = np.concatenate([keys, rng.integers(0, 2**64, 50, dtype=np.uint64), np.array([0, 2**64 - 1], np.uint64)])
        at, found = pitman_yor.Index(keys).find(asked)
        assert found.tolist() == np.isin(asked, keys).tolist() and (at[:n] == np.arange(n)).all()
        coder = pitman_yor.Coder(rng.permutation(keys))
        coded = pitman_yor.Coded.of(coder.codes(asked), asked)
        assert (coded.hashes(coder) == asked).all() and (coded.at(found).hashes(coder) == asked[found]).all()
        own, where = coded.distinct(coder)
        assert (own[where] == asked).all() and len(own) == len(np.unique(asked))


def test_seating_matches_expected_tables():
    rng = np.random.default_rng(3)
    d, weight = 0.5, 2.0
    for c in (2, 10, 200):
        tables = pitman_yor.seat(np.full(4000, c), np.full(4000, weight), d, rng.integers(0, 2**63, 4000).astype(np.uint64), 1)
        sums = []
        for _ in range(1500):
            t = 1
            for n in range(1, c):
                t += rng.random() < weight / (weight + n - d * t)
            sums.append(t)
        assert abs(tables.mean() - np.mean(sums)) < 0.06 * np.mean(sums) + 0.05


# --- secrets ------------------------------------------------------------------------
BASE = {
    "assign": (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), lambda m: len(m[2]) >= 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
}


def base_spans(text):
    found = [(m.start(), k, kind, m.end()) for k, (kind, (p, ok)) in enumerate(BASE.items()) for m in p.finditer(text) if ok(m)]
    return [(s, kind, e) for s, _, kind, e in sorted(found)]


def secret_texts():
    rng = random.Random(5)
    parts = ["password", "PassWd", "secret", "ſecret", "toKen", "api_key", "apikey", "APIKEY", '"', "'", " ", ":", "=", "abc", "abcdef", "x1+/_.=-", "AKIA", "ABCDEF0123456789",
             "deadbeef", "0123456789abcdef", "é", "日", "\n", "ghp_" + "a1" * 20, "-----BEGIN RSA PRIVATE KEY-----", "ftp://me:secret12@host"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(500)] + [None, "", "f" * 30_000, "token=" * 2000, 'secret: "token:abcdefgh', "tokenſ=abcdefgh"]


def test_spans_equal_python(spark):
    texts = secret_texts()
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, spans int")
    got = {r["doc_id"]: r for r in secrets.scan(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        spans = got[i]["spans"]
        assert [(s["start"], s["kind"], s["end"]) for s in spans if s["rank"] < 3] == base_spans(t or "")
        for rank, rule in enumerate(secrets.RULES[3:], 3):
            assert [(s["start"], s["end"]) for s in spans if s["rank"] == rank] == [m.span() for m in re.finditer(rule.pattern, t or "")]
    assert secrets.scan(docs.limit(0)).count() == 0


def test_trigram_queries_hold_for_matches():
    for rule in secrets.RULES:
        query = secrets.trigram_query(rule.pattern)
        for t in secret_texts():
            for m in re.finditer(rule.pattern, t or ""):
                low = m[0].lower()
                assert not query or any(all(tri in low for tri in alt) for alt in query)
    assert secrets.trigram_query("[0-9a-f]{24,}") == []
    assert sorted(map(sorted, secrets.trigram_query("(abc|de)f+x"))) == []  # 'de' leaves no trigram
    assert secrets.trigram_query("ab?cd") and {"acd"} in secrets.trigram_query("ab?cd")


def test_redaction(spark):
    docs = spark.createDataFrame([("a password=hunter2x b",), (None,), ("clean é",), ("token=" + "ab12" * 8,)], "text string")
    assert [r["text"] for r in secrets.redact(docs).collect()] == ["a [assign] b", None, "clean é", "[assign]"] or {r["text"] for r in secrets.redact(docs).collect()} == {"a [assign] b", None, "clean é", "[assign]"}
