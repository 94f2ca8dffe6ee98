import random
from collections import defaultdict

from pyspark.sql import functions as F

from fieldloom.operators import layout, pages, resolve, retrieval, tables
from fieldloom.streaming import limits


def test_latest_before_takes_the_last_event_at_or_before(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9), (4, None, 3)], "id int, k string, t int")
    events = spark.createDataFrame([("a", 5, 1), ("a", 5, 2), ("a", 6, 3), ("b", 10, 4)], "k string, t int, e int")
    got = {r.id: r.e for r in layout.latest_before(rows, events, ["k"], "t", ["e"], "e").collect()}
    assert got == {1: 2, 2: None, 3: None, 4: None}


def test_suppression_against_a_loop(spark):
    rnd = random.Random(4)
    boxes = [(p, i, float(rnd.randint(0, 60)), float(rnd.randint(0, 60)), float(rnd.randint(5, 40)), float(rnd.randint(5, 40))) for p in range(4) for i in range(60)]
    want = set()
    for p in range(4):
        kept = []
        for b in sorted((b for b in boxes if b[0] == p), key=lambda b: b[1]):
            shared = [max(0, min(b[2] + b[4], c[2] + c[4]) - max(b[2], c[2])) * max(0, min(b[3] + b[5], c[3] + c[5]) - max(b[3], c[3])) for c in kept]
            if all(s < 0.3 * (b[4] * b[5] + c[4] * c[5] - s) or s == 0 for s, c in zip(shared, kept)):
                kept.append(b)
        want |= {b[:2] for b in kept}
    df = spark.createDataFrame(boxes, "page int, id int, x double, y double, width double, height double")
    assert {(r.page, r.id) for r in layout.suppressed(df, ["page"], [F.col("id")]).collect()} == want
    pairs = layout.pairs_of(df, df, ["page"], 10.0)
    assert pairs.count() == pairs.select("page", "a_id", "b_id").distinct().count()


def test_limits_against_a_loop(spark):
    rnd = random.Random(8)
    rows = sorted((rnd.randint(0, 3), rnd.uniform(0, 500), rnd.random() < 0.6, i) for i in range(400))
    hits, state, want = defaultdict(list), defaultdict(lambda: [0, 0.0]), {}
    for k, t, bad, i in rows:
        hits[k] = [h for h in hits[k] if t - h <= 60]
        ok = len(hits[k]) < 5
        wait = 0 if ok else int(60 - (t - hits[k][0])) + 1
        if ok:
            hits[k].append(t)
        f = state[k]
        through = f[0] < 3 or t - f[1] >= 20
        if through:
            f[0] = min(f[0], 2)
            f[0] = f[0] + 1 if bad else 0
            f[1] = t if f[0] >= 3 else f[1]
        want[i] = (ok, wait, through)
    df = spark.createDataFrame(rows, "k int, t double, bad boolean, i int").repartition(3)
    a = {r.i: (r.allowed, r.retry_after) for r in limits.rate_limited(df, "k", "t", ["t", "i"], 5, 60.0).collect()}
    b = {r.i: r.allowed for r in limits.guarded(df, "k", "t", "bad", ["t", "i"], 3, 20.0).collect()}
    assert {i: (*a[i], b[i]) for i in a} == want


def test_stream_agrees_with_batch(spark, tmp_path):
    rows = [(i % 2, float(i * 7)) for i in range(60)]
    for n, part in enumerate((rows[:25], rows[25:])):
        spark.createDataFrame(part, "k long, t double").coalesce(1).write.parquet(str(tmp_path / f"in{n}"))
    source = spark.readStream.schema("k long, t double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in*"))
    run = limits.rate_limited_stream(source, "k", "t", 3, 60.0, expire=False).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    batch = limits.rate_limited(spark.createDataFrame(rows, "k long, t double"), "k", "t", ["t"], 3, 60.0)
    assert sorted(spark.table("limited").collect()) == sorted(batch.select("k", "t", "allowed", "retry_after").collect())


ALIASES = [("full_name", 1, 0, "Full Name", 1.1, "text"), ("full_name", 1, 1, "पूरा नाम", 1.1, "text"), ("date_of_birth", 2, 0, "Date of Birth", 1.1, "date"), ("account", 3, 0, "Bank Account Number", 1.0, "text"), ("relative", 4, 0, "Brother Name", 1.0, "text"), ("amount", 5, 0, "Amount", 1.0, "text"), ("amount", 5, 1, "Amount due", 1.0, "text"), ("work", 6, 0, "कामकाज", 1.0, "text")]
KEYWORDS = [("date_of_birth", 0, "born"), ("amount", 0, "total sum"), ("amount", 1, "rupees")]
NOISY = ["Full Name", "Ful Nane", "Dato of Birlh", "पूरा नाम", "परा नम", "Your Full Name here", "Your Ful Nane here", "Bank Account", "Bank Account Number", "Favourite Genre", "Mother Name", "Brothr Name", "", None, "total amount", "born on", "rupee5", "rupees sum total", "amount", "का काम", "Bank Acount Numbar", "due amount due"]


def by_hand(label, kind):
    """Entry, score of a label by the rules, one alias after the other."""
    from difflib import SequenceMatcher

    fold = lambda t: [w for w in (t or "").lower().translate({0x0942: None, 0x093E: None, 0x093C: None}).split()]
    lt, found = fold(label), {}
    if not lt:
        return None
    ratio = lambda a, b: 1.0 if a == b else SequenceMatcher(None, a, b).ratio()
    inside = lambda small, big: any(big[i : i + len(small)] == small for i in range(len(big) - len(small) + 1))
    for entry, _, _, alias, priority, of in ALIASES:
        at, share = fold(alias), min(1, len(fold(alias)) / len(lt))
        score, how = 0, ""
        if lt == at:
            score, how = 1.0, "exact"
        elif inside(at, lt):
            score, how = (0.5, "weak_token") if len(at) == 1 and len(lt) > 1 else (min(0.95, 0.58 + 0.37 * share), "contains")
        elif len(lt) > 1 and inside(lt, at):
            score, how = 0.74, "contained_by"
        else:
            for i in range(len(lt) - len(at) + 1):
                r = [0 if (min(len(a), len(b)) <= 2 and a != b) or abs(len(a) - len(b)) > 1 else ratio(a, b) for a, b in zip(lt[i:], at)]
                if min(r) >= 0.72 and sum(r) / len(r) >= 0.8:
                    score, how = max(score, 0.58 + 0.14 * (sum(r) / len(r) - 0.8) / 0.2 + 0.04 * share), "fuzzy_tokens"
        if score > found.get(entry, (0,))[0]:
            found[entry] = (score, how, len(at), priority, of)
    for entry, _, word in KEYWORDS:
        known = next(a for a in ALIASES if a[0] == entry)
        if entry not in found or found[entry][1].startswith("keyword") is None:
            if all(w in lt for w in word.split()):
                found.setdefault(entry, (0.56, "keyword", len(word.split()), known[4], known[5]))
            elif len(word.split()) == 1 and any(ratio(w, word) >= 0.9 for w in lt):
                found.setdefault(entry, (0.53, "keyword_fuzzy", 1, known[4], known[5]))
    best = None
    for entry in dict.fromkeys(a[0] for a in ALIASES):
        if entry in found:
            base, how, n, priority, of = found[entry]
            score = min(1, base * priority)
            if kind:
                score = min(1, score + 0.04) if kind == of else score - (0.08 if kind == "checkbox" else 0.01)
            score = round(score, 4)
            if best is None or (score > best[1] if abs(score - best[1]) > 0.02 else n > best[3]):
                best = (entry, score, how, n)
    return best[:3] if best and best[1] >= 0.52 and best[2] != "weak_token" else None


def test_resolve_against_the_rules(spark):
    known = spark.createDataFrame(ALIASES, "entry_id string, ord int, pos int, alias string, priority double, entry_type string")
    words = spark.createDataFrame(KEYWORDS, "entry_id string, pos int, keyword string")
    cases = [(x, k) for x in NOISY for k in (None, "text", "date", "checkbox")]
    got = {(r.label, r.field_type): (r.entry_id, round(r.score, 4), r.how) for r in resolve.resolve(spark.createDataFrame([*cases, cases[0]], "label string, field_type string"), known, words).collect()}
    want = {c: w for c in cases if (w := by_hand(*c))}
    assert {c: (e, how) for c, (e, _, how) in got.items()} == {c: (e, how) for c, (e, _, how) in want.items()}
    # both round to four places, of halves one up and one to the nearer in binary
    assert all(abs(got[c][1] - want[c][1]) < 1.1e-4 for c in got)
    assert got["Your Ful Nane here", "text"][0] == "full_name" and got["Bank Account", "text"][2] == "contained_by" and ("Favourite Genre", None) not in got


def test_patterns(spark):
    markers = spark.createDataFrame([("name_like", 0, "name", 0.9), ("number_like", 1, "number", 1.0), ("choice", 2, "tick", 1.3)], "pattern_id string, ord int, marker string, weight double")
    labels = spark.createDataFrame([("Number",), ("Name of ward number",), ("numbr of x",), ("tick",), ("ward",), (None,)], "label string")
    got = {r.label: (r.pattern_id, r.score) for r in resolve.match_pattern(labels, markers).collect()}
    assert got == {"Number": ("number_like", 0.72), "Name of ward number": ("number_like", 0.62), "numbr of x": ("number_like", 0.52), "tick": ("choice", 0.9)}


def test_form_match(spark):
    forms = spark.createDataFrame([(1, "bank", "banking", ["bank", "account type", "nominee"], ["nominee", "occupation"]), (2, "card", "other", ["ration", "epic"], ["member"])], "ord int, form_id string, category string, terms array<string>, aliases array<string>")
    docs = spark.createDataFrame([(1, "Demo Bank account type nominee occupation savings", ["Nominee"]), (2, "library card favourite genre membership", []), (3, None, None)], "id int, text string, labels array<string>")
    got = {r.id: r.form_id for r in retrieval.match_form(docs, forms, F.coalesce("text", F.lit("")), F.coalesce("labels", F.array()), F.lit("banking")).collect()}
    assert got == {1: "bank", 2: None, 3: None}


def test_null_keys_are_one_key(spark):
    rows = [(None, float(t), t % 2 == 0, t) for t in range(6)] + [(1, 0.5, True, 9)]
    df = spark.createDataFrame(rows, "k int, t double, bad boolean, i int")
    assert [r.allowed for r in limits.rate_limited(df, "k", "t", ["t"], 2, 60.0).where("k IS NULL").orderBy("t").collect()] == [True, True, False, False, False, False]
    assert limits.guarded(df.withColumn("bad", F.lit(True)), "k", "t", "bad", ["t"], 3, 60.0).where("allowed").count() == 4


def test_cache_drops_the_oldest(spark):
    rows = [(1, i, k) for i, k in enumerate("abacabb")] + [(1, 90, None), (1, 91, None)]
    got = limits.cached(spark.createDataFrame(rows, "c int, i int, k string"), "c", "k", "i", ["i"], capacity=2).orderBy("i").collect()
    assert [(r.hit, r.served) for r in got] == [(False, 0), (False, 1), (True, 0), (False, 3), (False, 4), (False, 5), (True, 5), (False, 90), (True, 90)]


def test_lexical_ways_agree(spark):
    rnd = random.Random(6)
    make = lambda n: [(i, " ".join(rnd.choice("abcdefghij") * rnd.randint(1, 2) for _ in range(rnd.randint(0, 9)))) for i in range(n)] + [(n, None)]
    q, d = spark.createDataFrame(make(12), "q int, text string"), spark.createDataFrame(make(200), "d int, text string").repartition(5)
    ways = [sorted(map(tuple, retrieval.lexical_topk(q, d, "q", "d", most_tokens=m).collect())) for m in (0, 10_000)]
    assert ways[0] == ways[1] and len(ways[0]) > 40


def test_vectors_against_a_loop(spark):
    rnd = random.Random(2)
    v = [(i, [float(rnd.randint(-3, 3)) for _ in range(4)]) for i in range(90)] + [(90, None)]
    df = spark.createDataFrame(v, "id long, v array<float>")
    got = {(r.query, r.rank): r.vector for r in retrieval.vector_topk(df.where("id < 7"), df, "id", "v", 4).collect()}
    for i, a in v[:7]:
        want = sorted((sum((x - y) ** 2 for x, y in zip(a, b)), j) for j, b in v[:90])[:4]
        assert [got[i, r] for r in (1, 2, 3, 4)] == [j for _, j in want]


BOXES = "page int, id int, x double, y double, width double, height double"


def test_labels_beside_or_above(spark):
    fields = spark.createDataFrame([(1, 1, 0.5, 0.2, 0.3, 0.02, False), (1, 2, 0.5, 0.4, 0.3, 0.02, False), (1, 3, 0.1, 0.6, 0.3, 0.02, True), (1, 4, 0.5, 0.41, 0.3, 0.02, False)], BOXES + ", rtl boolean")
    words = [(1, 11, 0.2, 0.2, 0.05, 0.02, "far"), (1, 12, 0.38, 0.2, 0.05, 0.02, "Full"), (1, 13, 0.44, 0.2, 0.05, 0.02, "Name"), (1, 14, 0.495, 0.2, 0.004, 0.02, ":"), (1, 15, 0.5, 0.37, 0.1, 0.02, "Date"), (1, 16, 0.61, 0.37, 0.05, 0.02, "due"), (1, 17, 0.42, 0.6, 0.05, 0.02, "نام"), (1, 18, 0.48, 0.6, 0.05, 0.02, "پورا")]
    got = {r.id: r.label for r in pages.nearest_labels(fields, spark.createDataFrame(words, BOXES + ", text string"), ["page"], ["y", "x"]).collect()}
    assert got == {1: "Full Name", 2: "Date due", 3: "پورا نام", 4: None}


def test_better_of_two_readings(spark):
    lines = [(1, 1, 0.0, 0.0, 100.0, 10.0, 50.0), (1, 2, 5.0, 1.0, 100.0, 10.0, 70.0), (1, 3, 200.0, 0.0, 50.0, 10.0, 10.0), (1, 4, 0.0, 2.0, 90.0, 10.0, 70.0), (2, 1, 0.0, 0.0, 100.0, 10.0, 1.0)]
    kept = pages.single_readings(spark.createDataFrame(lines, BOXES + ", conf double"), ["page"], F.col("conf"), ["y", "x"])
    assert {(r.page, r.id) for r in kept.collect()} == {(1, 2), (1, 3), (2, 1)}


def test_template_names_and_adds(spark):
    fields = spark.createDataFrame([(1, 1, 0, 0.1, 0.2, 0.2, 0.02, "misread", "hi"), (1, 2, 0, 0.1, 0.21, 0.2, 0.02, "second", "hi"), (2, 1, 0, 0.1, 0.2, 0.2, 0.02, "free", None)], "doc int, id int, page int, x double, y double, width double, height double, label string, form_language string")
    slots = spark.createDataFrame([("hi", 0, 0, 0.1, 0.2, 0.2, 0.02, "name", False), ("hi", 1, 0, 0.12, 0.2, 0.2, 0.02, "place", False), ("hi", 2, 0, 0.1, 0.2, 0.2, 0.02, "date", True), ("hi", 3, 1, 0.1, 0.2, 0.2, 0.02, "none", False)], "form_language string, slot int, page int, x double, y double, width double, height double, label string, insert boolean")
    got = sorted(map(tuple, pages.template_labels(fields, slots, ["doc"]).collect()), key=repr)
    assert got == [(1, 1, "name", False), (1, 2, "place", False), (1, None, "date", True), (2, 1, "free", False)]


def test_table_context(spark):
    cells = [(1, 1, 0.0, 0.0, 100.0, 20.0, "Elector", False), (1, 2, 100.0, 0.0, 100.0, 20.0, "Relative", False), (1, 3, 0.0, 30.0, 60.0, 20.0, "AC No", False), (1, 4, 100.0, 30.0, 60.0, 20.0, "Part", False), (1, 5, 0.0, 60.0, 60.0, 20.0, "", True), (1, 6, 100.0, 60.0, 60.0, 20.0, "", True), (2, 1, 0.0, 0.0, 50.0, 20.0, "Name:", False), (2, 2, 60.0, 0.0, 50.0, 20.0, "", True)]
    df = spark.createDataFrame(cells, BOXES + ", text string, is_blank boolean").withColumn("rtl", F.lit(False)).withColumn("text_left", F.col("x")).withColumn("text_right", F.col("x") + F.col("width"))
    got = {(r.page, r.id): (r.column_header, r.row_caption, r.sub_header) for r in pages.cell_context(pages.table_cells(df, ["page"]), ["page"]).collect()}
    assert got == {(1, 5): ("Elector", "", "AC No"), (1, 6): ("Relative", "", "Part"), (2, 2): ("", "Name:", "")}


def test_readers(spark, tmp_path):
    from fieldloom.sources import readers

    for name, raw in {"a.txt": b"%PDF-1.7", "b.pdf": b"\x89PNG\r\n\x1a\n..", "c": b"\xff\xd8\xff\xe0", "d": b"RIFF1234WEBPxx", "f": b"GIF89a"}.items():
        (tmp_path / name).write_bytes(raw)
    got = {r.path[-1] if "." not in r.path[-5:] else r.path[-5:]: (r.mime, r.error) for r in readers.uploads(spark, str(tmp_path)).collect()}
    assert sorted(got.values(), key=str) == sorted([("application/pdf", None), ("image/png", None), ("image/jpeg", None), ("image/webp", None), (None, "unknown_type")], key=str)
    forms = tmp_path / "forms"
    forms.mkdir()
    for i, body in enumerate(['{"form_id": "a", "display_name": "old"}', '{\n"form_id": "a", "display_name": "new", "fields": [{"field_id": "f", "aliases": ["x"]}]}', "broken"]):
        (forms / f"{i}.json").write_text(body)
    known = readers.known_forms(spark, str(forms))
    assert [r.display_name for r in known.collect()] == ["new"] and readers.form_fields(known).first().field_id == "f"
    assert readers.dictionary(spark, str(tmp_path / "absent")).count() == 0
    entry = tmp_path / "dict"
    entry.mkdir()
    (entry / "e.json").write_text('{"id": "n", "aliases": {"en": ["name", "full name"], "hi": ["पूरा नाम"]}, "texts": {"en": "write it", "hi": "लिखें"}}\n')
    rows = readers.alias_rows(readers.dictionary(spark, str(entry))).orderBy("pos").collect()
    assert [r.alias for r in rows] == ["full name", "पूरा नाम", "name"]
    assert readers.audit(readers.dictionary(spark, str(entry)), ["en", "hi", "kn"]).count() == 2
    vectors = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id int, embedding array<double>")
    try:
        readers.replace_index(vectors, str(tmp_path / "index"))
        raise AssertionError
    except ValueError:
        readers.replace_index(vectors.limit(1), str(tmp_path / "index"))


def test_joined_topk_against_all_pairs(spark):
    rnd = random.Random(12)
    words = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(["common"] * (rnd.random() < 0.9) + [words[min(39, int(rnd.expovariate(0.15)))] for _ in range(n)])
    docs, queries = [(i, text(rnd.randint(0, 14))) for i in range(150)], [(i, text(rnd.randint(0, 9))) for i in range(40)]
    want = set()
    for q, t in queries:
        a = set(t.split())
        scored = sorted((-round(len(a & set(u.split())) / len(a | set(u.split())), 6), d) for d, u in docs if a & set(u.split()))
        want |= {(q, d, -s, r + 1) for r, (s, d) in enumerate(scored[:5])}
    q, d = spark.createDataFrame(queries, "q int, text string"), spark.createDataFrame(docs, "d int, text string")
    for most in (0, 10_000):
        assert {tuple(r) for r in retrieval.lexical_topk(q, d, "q", "d", most_tokens=most).collect()} == want


def test_buckets_change_no_result(spark):
    rnd = random.Random(21)
    rows = spark.createDataFrame([(rnd.choice([1, 1, 1, 2, None]), i, float(rnd.randint(0, 300))) for i in range(200)], "k int, id int, t double")
    events = spark.createDataFrame([(rnd.choice([1, 2, None]), i, float(rnd.randint(0, 300)), None if i % 7 == 0 else f"e{i}") for i in range(40)], "k int, e int, t double, name string")
    bucket = lambda c: F.floor(c / 25)
    same = lambda a, b: sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    assert same(layout.latest_before(rows, events, ["k"], "t", ["e", "name"], "e"), layout.latest_before(rows, events, ["k"], "t", ["e", "name"], "e", bucket))
    clusters = lambda b: layout.gap_clusters(rows, ["k"], F.col("t"), ["t", "id"], 4.0, b)
    assert same(clusters(None), clusters(bucket(F.col("t")))) and clusters(None).agg(F.max("cluster")).first()[0] > 5
    assert same(tables.batches(rows, ["k"], ["t", "id"], 7), tables.batches(rows, ["k"], ["t", "id"], 7, bucket(F.col("t"))))


def test_keys_over_many_batches(spark):
    from fieldloom.operators.paged import per_key

    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([1.0, 2.0, None]), i) for i in range(300)] + [("hot", 1.0, 1000 + i) for i in range(200)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame(rows, "k string, j double, i int")
        got = per_key(df, ["k", "j"], ["i"], ["i"], lambda own: [(n, len(own)) for n, _ in enumerate(own)], "n int, of int").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    held = defaultdict(list)
    for k, j, i in sorted(rows, key=lambda r: r[2]):
        held[k, j].append(i)
    assert {(r.i, r.n, r.of) for r in got} == {(i, n, len(v)) for v in held.values() for n, i in enumerate(v)}


def test_forms_in_blocks_score_alike(spark, monkeypatch):
    forms = spark.createDataFrame([(i, f"f{i}", "bank" if i % 2 else "tax", [f"Term{i}", "account"], [f"alias{i % 3}", "x"]) for i in range(9)], "ord int, form_id string, category string, terms array<string>, aliases array<string>")
    docs = spark.createDataFrame([(1, "TERM3 of an ACCOUNT", ["Alias0"]), (2, "term5", []), (3, None, None), (1, "term3 of an account", ["alias0"]), (4, "nothing", ["a long ALIAS2 here"])], "id int, text string, labels array<string>")
    match = lambda: sorted(((r.id, r.form_id, r.form_score) for r in retrieval.match_form(docs, forms, F.col("text"), F.col("labels"), F.lit("bank"), 0.3).collect()), key=repr)
    whole = match()
    assert whole[0] == whole[1] == (1, "f3", 0.87)
    monkeypatch.setattr(retrieval, "FORMS_BLOCK", 2)
    assert match() == whole
    none = retrieval.match_form(docs, forms.where("ord < 0"), F.col("text"), F.col("labels"), F.lit("bank")).collect()
    assert len(none) == 5 and all(r.form_id is None for r in none)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_of_no_chain_are_not_moved(spark):
    from fieldloom.operators import bundle

    resolved = spark.createDataFrame([(1, "known", 0.9, "Name", None, None), (2, "retrieved", 0.5, None, None, "c")], "field int, source string, score double, label string, display_label string, concept string")
    texts = spark.createDataFrame([(1, "kb", "what_to_enter", "en", "write"), (1, "kb", "id", "en", "no chain asks for it"), (2, "hit", "what_to_enter", "hi", "नाम"), (2, "kb", "note", "", "x")], "field int, origin string, part string, language string, text string")
    messages = spark.createDataFrame([("unavailable", "en", "none")], "key string, language string, message string")
    found = bundle.bundle(resolved, texts, messages, ["en", "hi"])
    rows = {(r.field, r.language): r for r in found.collect()}
    assert rows[1, "en"].what_to_enter == "write" and rows[2, "hi"].what_to_enter == "नाम" and rows[2, "en"].what_to_enter == "none"
    assert "LeftSemi" in _plan(found)


def test_queries_sent_or_joined_retrieve_the_same(spark):
    from fieldloom.operators import retrieval

    say = lambda i, n: " ".join(f"w{(i * k) % 17}" for k in range(1, n))
    queries = spark.createDataFrame([(i, say(i, 6), ["en", "de", None][i % 3], [None, "a", "z"][i % 4 % 3]) for i in range(12)], "query int, text string, language string, form_id string")
    chunks = spark.createDataFrame([(i, say(i, 3 + i % 9), ["en", "de"][i % 2], ["a", "b", None][i % 3]) for i in range(60)] + [(90, None, "en", "a")], "chunk int, text string, language string, form_id string")
    found = [sorted(map(tuple, retrieval.retrieved(queries, chunks, 0.1, 0.2, most_tokens=n).collect())) for n in (0, 10**6)]
    assert found[0] == found[1] and len(found[0]) > 20 and any(r[4] for r in found[0])


def test_tokens_of_documents_are_found_once(spark):
    from fieldloom.operators import retrieval

    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc int, text string")
    assert _plan(retrieval.lexical_topk(docs, docs, "doc", "doc")).count("regexp_extract_all(") == 1


def test_distances_stand_in_slices_of_queries():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from fieldloom.operators import retrieval

    rng = np.random.default_rng(3)
    side = lambda n: pa.table({"id": pa.array(np.arange(n)), "v": pa.FixedSizeListArray.from_arrays(pa.array(rng.random(n * 8)), 8).cast(pa.list_(pa.float64()))})
    q, v = side(512), side(8192)
    tracemalloc.start()
    found = retrieval._nearest(3)((), q, v)
    assert tracemalloc.get_traced_memory()[1] < 24 << 20 and found.num_rows == 3 * 512
    tracemalloc.stop()
    m = retrieval._matrix(v.column("v"))
    assert found.column("vector").to_pylist()[:3] == np.argsort(((m - retrieval._matrix(q.column("v"))[0]) ** 2).sum(1))[:3].tolist()


def test_fold_tells_null_keys_from_nan(spark):
    from fieldloom.operators.paged import per_key

    rows = [(None, 1, ["a"]), (float("nan"), 1, ["b"]), (float("nan"), 2, None), (None, 2, ["c"]), (1.0, 1, ["d"])]
    found = per_key(spark.createDataFrame(rows, "k double, at int, kept array<string>").coalesce(1), ["k"], ["at"], ["at"], lambda x: [(len(x), None if len(x) == 1 else "several")] * len(x), "n int, said string")
    assert sorted((str(r.k), r.at, r.kept, r.n, r.said) for r in found.collect()) == [("1.0", 1, ["d"], 1, None), ("None", 1, ["a"], 2, "several"), ("None", 2, ["c"], 2, "several"), ("nan", 1, ["b"], 2, "several"), ("nan", 2, None, 2, "several")]
