"""Operators without SQL against plain versions on small tables."""

import hashlib
import math
import random
import re
import tempfile
import zlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from probatio.llm import decontamination, language, mixing, near_duplicates, ppm, quality, queries, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def test_quality_measures(spark, docs):
    for row in queries.op3_quality_rules(spark, SF).collect():
        text = docs[row["doc_id"]] or ""
        words = WORD.findall(text)
        windows = defaultdict(list)
        for i in range(len(words) - 7):
            windows[tuple(words[i : i + 8])].append(i)
        repeated = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        expected = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated))
        assert tuple(row[n] for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == expected
        assert row["base_failed"] == (len(words) < 20 or 100 * len(repeated) > 30 * len(words))
        assert not (row["base_failed"] and row["kept"])


def test_ablations(spark):
    rows = quality.apply_policy(quality.ledger(spark.read.parquet(f"{SF}/documents.parquet"))).collect()
    fails = [{r.name for i, r in enumerate(quality.RULES) if row["fail_bits"] >> i & 1} for row in rows]
    found = {(r["policy"], r["rule"]): (r["n_docs"], r["n_kept"], r["n_kept_without"]) for r in quality.ablations(spark.createDataFrame(rows)).collect()}
    expected = {}
    for policy, names in quality.POLICIES.items():
        for name in names:
            kept = [sum(not (failed & rules) for failed in fails) for rules in (set(names), set(names) - {name})]
            expected[policy, name] = (len(rows), *kept)
    assert found == expected
    current = set(quality.POLICIES[quality.CURRENT])
    for row, failed in zip(rows, fails):
        alone = failed & current
        assert row["ablated_bits"] == (sum(1 << i for i, r in enumerate(quality.RULES) if r.name in alone) if len(alone) == 1 else 0)


def test_quality_keeps_good_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    rows = quality.apply_policy(quality.ledger(docs)).join(labels, "doc_id").where("quality IS NOT NULL").collect()
    good, bad = ([r["kept"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert sum(good) >= 0.95 * len(good) > 0 and sum(bad) <= 0.05 * len(bad)


def plain_links(docs):
    """The other documents at a similarity of 0.8 or more, by comparing all pairs that share a 5-gram."""
    grams, holders = {}, defaultdict(set)
    for i, text in docs.items():
        words = [w.lower() for w in WORD.findall(text or "")]
        grams[i] = {tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))} if words else set()
        for g in grams[i]:
            holders[g].add(i)
    links = {}
    for i in docs:
        common = Counter(j for g in grams[i] for j in holders[g] if j != i)
        links[i] = {j for j, n in common.items() if n >= 0.8 * (len(grams[i]) + len(grams[j]) - n)}
    return links


def groups_of(links):
    group = {}
    for i in sorted(links):
        if i not in group:
            todo = [i]
            while todo:
                if (x := todo.pop()) not in group:
                    group[x] = i
                    todo += links[x]
    return group


@pytest.mark.parametrize("folder", [SF, "/root/testdata/sf0.01"])
def test_near_duplicates(spark, folder):
    """All links of the definition are found: recall and precision of 1 on these tables."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    links = plain_links(docs)
    group = groups_of(links)
    for row in queries.op5_jaccard_join(spark, folder).collect():
        assert (row["class_id"], row["n_links"]) == (group[row["doc_id"]], len(links[row["doc_id"]]))


def test_near_duplicates_in_many_blocks(spark, docs):
    """The same links whatever the blocks: components are cut into blocks of two classes."""
    base = "a b c d e f g h i j k l m n o p q r s t u v w x y z".split()
    near = {10_000 + i: " ".join([*base, *base[::-1], f"end{i}"]) for i in range(9)}
    docs = docs | near | {20_000: near[10_000]}
    links = plain_links(docs)
    table = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    found = near_duplicates.join_classes(table, block_classes=2, block_chars=400).collect()
    by_key = {r["key"]: r for r in found}
    keys = {i: hashlib.md5((t or "").encode()).hexdigest() for i, t in docs.items()}
    for i, key in keys.items():
        if (docs[i] or "").split():
            assert by_key[key]["linked"] + by_key[key]["n_docs"] - 1 == len(links[i])
            assert all(by_key[keys[j]]["group"] == by_key[key]["group"] for j in links[i])
    assert len({by_key[keys[i]]["group"] for i in near}) == 1


def test_components(spark):
    """Long paths and a node with very many edges."""
    edges = [(f"p{i:03}", f"p{i + 1:03}") for i in range(60)] + [("hub", f"x{i}") for i in range(400)] + [("x1", "x2"), ("z", "z")]
    rows = near_duplicates.components(spark.createDataFrame(edges, "a string, b string")).collect()
    found = {r["node"]: r["component"] for r in rows}
    assert len(rows) == len(found) == 61 + 401
    assert all(found[f"p{i:03}"] == "p000" for i in range(61)) and all(found[f"x{i}"] == "hub" for i in range(400))


def test_components_take_few_jobs(spark):
    """Stars need no round, only a look: the driver plans every round and keeps what Spark tells of it."""
    stars = spark.createDataFrame([("ab"[i % 2], f"x{i:03}") for i in range(400)], "a string, b string")
    spark.sparkContext.setJobGroup("stars", "stars")
    found = {r["node"]: r["component"] for r in near_duplicates.components(stars).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("stars"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found == {f"x{i:03}": "ab"[i % 2] for i in range(400)} | {"a": "a", "b": "b"}
    assert jobs <= 12, jobs


def test_features_travel_packed(docs):
    """What reaches the driver of a text is what its features hold, and a fraction of the bytes."""
    sizes = []
    for text in ["", "a", "élan \U0001f600 ab" * 9, *[t for t in docs.values() if t][:50]]:
        x, back = language.features(text), language.np.zeros(language.SLOTS, language.np.float32)
        language.unpack(data := language.packed(x), back)
        assert back.tobytes() == x.tobytes()
        sizes.append(len(data))
    assert sum(sizes) < 0.5 * 4 * language.SLOTS * len(sizes)


def best_distance(item, text):
    """Sellers' algorithm: the least edit distance of the item to a passage."""
    column = list(range(len(item) + 1))
    least = column[-1]
    for c in text:
        last, column[0] = column[0], 0
        for i, x in enumerate(item, 1):
            last, column[i] = column[i], min(last + (x != c), column[i] + 1, column[i - 1] + 1)
        least = min(least, column[-1])
    return least


@pytest.mark.parametrize("block_chars", [decontamination.BLOCK_CHARS, 30])
def test_edit_matching(spark, block_chars):
    items = ["the quick brown fox jumps over the lazy dog near the river", "short one", "ninety nine bottles of beer stand on the wall of the old mill"]
    texts = [
        "x " + items[0].upper() + " y", items[0].replace("quick", "quack").replace("lazy", "lzy"), items[2][3:], items[2].replace("b", "p").replace("t", "d"),
        "short on", "SHORT\nONE", items[0][:30] + "zzzzzzzz" + items[0][30:], "", None,
    ]
    a = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    expected = set()
    for i, text in enumerate(texts):
        for j, item in enumerate(items):
            distance = best_distance(item, decontamination.normalise(text or ""))
            if distance <= math.floor(decontamination.ERROR_RATE * len(item)):
                expected.add((i, j, distance))
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in decontamination.contaminations(a, b, block_chars=block_chars).collect()} == expected
    assert len(expected) >= 3


def plain_ppm(train, text):
    """log10 probability of a text, byte by byte, by PPM method C with exclusion."""
    counts = defaultdict(Counter)
    pad = [ppm._START] * ppm.ORDER
    for t in train:
        data = pad + list(t) + [ppm._END]
        for i in range(ppm.ORDER, len(data)):
            for order in range(ppm.ORDER + 1):
                counts[tuple(data[i - order : i])][data[i]] += 1
    data, total = pad + list(text) + [ppm._END], 0.0
    for i in range(ppm.ORDER, len(data)):
        excluded: set = set()
        for order in range(ppm.ORDER, -1, -1):
            here = {s: n for s, n in counts[tuple(data[i - order : i])].items() if s not in excluded}
            if not here:
                continue
            space = sum(here.values()) + len(here)
            if data[i] in here:
                total += math.log10(here[data[i]] / space)
                break
            total += math.log10(len(here) / space)
            excluded |= set(here)
        else:
            total -= math.log10(max(1, 256 - len(counts[()])))
    return total


@pytest.mark.parametrize("tree", [{}, {"block_bytes": 20, "fan": 2, "split": 3}])
def test_ppm(spark, tree):
    """One block, and blocks of 20 bytes that merge two by two over several levels."""
    texts = {i: t for i, t in enumerate(["the cat sat on the mat", "The cat ate the rat", "a rat sat", "", "zebra é zebra", "the mat", "on the cat", None, "sat sat sat sat", "quiz", "the hat", "mat mat"] * 2)}
    docs = spark.createDataFrame([(i, t, "s") for i, t in texts.items()], "doc_id long, text string, source string")
    low = {i: re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for i, t in texts.items()}
    train = [t.encode() for i, t in low.items() if crc(i) % 10]
    tokens = Counter(w for i, t in low.items() if crc(i) % 10 for w in [*WORD.findall(t), None])
    n, v = sum(tokens.values()), len(tokens)
    rows = ppm.score_documents(docs, **tree).collect()
    assert len(rows) == len(texts)
    for row in rows:
        words = [*WORD.findall(low[row["doc_id"]]), None]
        base = sum(math.log10((tokens[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        assert (row["held_out"], row["n_tokens"], row["n_known"], row["train_tokens"]) == (crc(row["doc_id"]) % 10 == 0, len(words), sum(tokens[w] > 0 for w in words), n)
        assert row["base_score"] == pytest.approx(base, rel=1e-5)
        assert row["score"] == pytest.approx(plain_ppm(train, low[row["doc_id"]].encode()), rel=1e-4)


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.98 * len(rows) > 0


OTHER_LANGUAGES = ["Это предложение написано на русском языке, и его не должно быть здесь.", "これは日本語の文章です。とても長い文章を書いています。", "xq zzvk wqpt jjxk vvqz kxwq zzpt qqwv jkxz vwqx zzkj", "1234 5678", "", None]


def test_language_plainly(spark, docs):
    """Predictions by plain dot products and votes; what no learned language explains scores near 0."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(table)
    w, langs = model.weights.astype(float), model.langs
    for text in [t for t in docs.values() if t and any(map(str.isalpha, t))][:60]:
        x = language.features(text).astype(float)
        values = [sum(x[i] * w[i][k] for i in x.nonzero()[0]) + model.bias[k] for k in range(w.shape[1])]
        family = model.families[0 if values[0] >= 0 else 1]  # two families: one machine
        members, votes = model.groups[family], Counter()
        for (name, a, b), v in zip(model.pairs, values[1:]):
            if name == family:
                votes[a if v >= 0 else b] += 1
        lang, score = model.predict(text)
        assert lang in members and votes[lang] == max(votes.values())
        assert 0 <= score <= 1
    assert langs == sorted(langs) and all(model.predict(t)[1] < 1e-3 for t in OTHER_LANGUAGES)
    odd = spark.createDataFrame([(i, t) for i, t in enumerate(OTHER_LANGUAGES)], "doc_id long, text string")
    kept = language.with_language(odd, model).where("language.score >= 0.01")
    assert kept.count() == 0


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    rows = toxicity.score(docs, labels).join(labels, "doc_id").where("held_out AND toxic IS NOT NULL").collect()
    assert sum(r["toxic"] == r["predicted"] for r in rows) >= 0.85 * len(rows) > 0


def every_path(machines, symbols):
    """All (cost, events) of a clause: each machine's whole outputs are fed to the next one."""
    paths = [(0, list(symbols))]
    for machine in machines:
        outs = []
        for cost, read in paths:
            alive = [(cost, machine.start, [])]
            for symbol in read:
                alive = [(c + more, to, [*out, written]) for c, state, out in alive for written, to, more in machine.arcs(state, symbol)]
            outs += [(c, out) for c, state, out in alive if machine.ends(state)]
        paths = outs
    return paths


def test_grammar_by_all_paths():
    rng = random.Random(5)
    kinds = ["insult", "verb", "frame", "target", "neg", "report", "quote", "other"]
    order = toxicity._GRAVITY
    for _ in range(400):
        clause = rng.choices(kinds, k=rng.randint(1, 9))
        grammar = toxicity.composed()
        ranked = [(cost, min((order.index(e) for e in events if e), default=len(order))) for cost, events in every_path(grammar.machines, clause)]
        best = min(ranked)[1] if ranked else len(order)
        assert grammar.gravest(clause) == (order[best] if best < len(order) else None), clause


@pytest.mark.parametrize(
    "text, event",
    [
        ("You are an idiot.", "insult_aimed"), ("the fool", "insult"), ("what a clown you are", "insult_aimed"),
        ("I'll kill you", "threat_aimed"), ("Kill yourself!", "threat_aimed"), ("the town will burn", "threat"),
        ("you aren’t an idiot", "negated"), ("You are not stupid", "negated"), ("I will not hurt you", "negated"),
        ("he said you are an idiot", "reported"), ('He wrote "you idiot" on it', "reported"), ('"you idiot', "insult_aimed"),
        ("I am not stupid, you worthless idiot", "insult_aimed"), ("they burn wood", None), ("burn wood at home", None), ("a fine day", None),
    ],
)
def test_grammar_probes(text, event):
    counts = dict(zip(toxicity.SYMBOLS, toxicity.Grammar().counts(text)))
    assert {k: v for k, v in counts.items() if v} == ({event: 1} if event else {})


def test_grammar_beats_word_presence(spark):
    """Texts with the same words: insults that are meant, negated or reported. Word presence cannot tell them apart."""
    meant = ["You are an idiot.", "What a stupid clown you are!", "You worthless moron.", "They are pathetic losers.", "I will hurt you."]
    told = ["You are not an idiot.", "He said you are a clown.", 'The note read "you worthless moron" to all.', "They are no losers.", "I will not hurt you."]
    rows = [(i, text, int(text in meant)) for i, text in enumerate((meant + told) * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    found = toxicity.score(docs, docs.select("doc_id", "toxic")).collect()
    assert all(r["predicted"] == rows[r["doc_id"]][2] for r in found)


def plain_pipeline(docs, items, model):
    """What the stages keep, by plain versions of them: doc_id to row."""
    kept = {i: r for i, r in docs.items() if model.predict(r["text"])[0] != "und" and model.predict(r["text"])[1] >= corpus_pipeline.LEAST_LANGUAGE_SCORE}
    yield dict(kept)
    rules = [r for r in quality.RULES if r.name in quality.POLICIES[quality.CURRENT]]
    names = [c.split()[0] for c in quality._MEASURES.split(", ")]
    for i in list(kept):
        values = dict(zip(names, quality.measures(kept[i]["text"])))
        if any(eval(rule.fails.replace(" OR ", " or "), {}, values) for rule in rules):
            del kept[i]
    yield dict(kept)
    group = groups_of(plain_links({i: r["text"] for i, r in kept.items()}))
    kept = {i: r for i, r in kept.items() if group[i] == i}
    yield dict(kept)
    budget = {text: math.floor(decontamination.ERROR_RATE * len(text)) for text in items}
    for i in list(kept):
        text = decontamination.normalise(kept[i]["text"])
        if any(best_distance(item, text) <= k for item, k in budget.items()):
            del kept[i]
    yield dict(kept)


def test_pipeline(spark, docs):
    """Each stage against a plain version, then the mix: sources meet the targets of a plain water-filling."""
    source = spark.read.parquet(f"{SF}/documents.parquet")
    benchmark = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(2).collect()]
    items = spark.createDataFrame(list(enumerate(benchmark)), "item_id long, text string")
    rows = [r.asDict() for r in source.orderBy("doc_id").limit(70).collect()]
    last = max(r["doc_id"] for r in rows)
    short = min((r for r in rows if r["text"] and 60 < len(r["text"].split()) < 200), key=lambda r: len(r["text"]))
    planted = [short["text"] + " end", short["text"][:200] + " " + benchmark[0] + " " + short["text"][200:], "Это предложение на русском языке. " * 9, "the of " * 3, None, ""]
    rows += [{"doc_id": last + 1 + n, "text": text, "lang": "en", "source": "s0", "n_chars": None} for n, text in enumerate(planted)]
    table = spark.createDataFrame(rows, source.schema)
    folder = tempfile.mkdtemp()
    table.write.parquet(f"{folder}/documents.parquet")
    items.write.parquet(f"{folder}/benchmark.parquet")
    model = language.fit(table)
    kept = spark.read.parquet(f"{folder}/documents.parquet")
    expected = plain_pipeline({r["doc_id"]: r for r in rows}, [decontamination.normalise(t) for t in benchmark], model)
    for (name, stage), wanted in zip(corpus_pipeline.STAGES[:-1], expected):
        after = stage(spark, kept, folder)
        assert after.columns == source.columns
        kept = spark.createDataFrame(after.collect(), source.schema)
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted(wanted), name
    assert wanted and len(wanted) < len(rows)
    mixed = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert sorted(mixed) == sorted(wanted)
    sizes = Counter()
    for i, r in wanted.items():
        sizes[r["source"]] += len(WORD.findall(r["text"]))
    weights = {s: mixing.WEIGHTS[n % 3] for n, s in enumerate(sorted(sizes))}
    targets, free = {}, set(sizes)
    while free:
        left, share = sum(sizes.values()) - sum(targets.values()), sum(weights[s] for s in free)
        over = {s for s in free if 3 * sizes[s] <= left * weights[s] / share}
        if not over:
            targets |= {s: left * weights[s] / share for s in free}
            break
        targets |= {s: 3 * sizes[s] for s in over}
        free -= over
    for s, target in targets.items():
        taken = [mixed[i]["taken"] for i, r in wanted.items() if r["source"] == s]
        assert sum(taken) == pytest.approx(target, abs=1)
        assert all(mixed[i]["target"] == pytest.approx(target) for i, r in wanted.items() if r["source"] == s)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in mixed.values())
