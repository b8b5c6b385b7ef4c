"""Ticker dictionary, fuzzy matching and resolution against plain walks."""

import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsloom.catalogue.tables import TICKER_ROWS
from newsloom.operators import fuzzy, tickers as resolve
from newsloom.operators.patterns import NameTrie, PatternTable
from newsloom.plans.articles import enrich
from newsloom.sources.tickers import alias_index, alias_owner, load_tickers, tickers_from_rows

CSV = """symbol,name,aliases
 aapl ,Apple Inc,"Apple; Apple Computer;;Apple"
AMZN,Amazon.com, Inc.,"Amazon;Amazon.com"
NONE,,x;y
"""


@pytest.fixture(scope="module")
def dictionary(spark):
    return tickers_from_rows(spark, TICKER_ROWS).persist()


def test_load_tickers(spark, tmp_path):
    path = tmp_path / "tickers.csv"
    path.write_text(CSV)
    rows = {r["symbol"]: (r["name"], r["aliases"], r["ord"]) for r in load_tickers(spark, str(path)).collect()}
    assert rows == {
        "AAPL": ("Apple Inc", ["Apple Inc", "Apple", "Apple Computer"], 0),
        "AMZN": ("Amazon.com", ["Amazon.com", "Inc."], 1),
        "NONE": ("", ["x", "y"], 2),
    }
    fixed = {r["symbol"]: r["aliases"] for r in load_tickers(spark, str(path), repair=True).collect()}
    assert fixed["AMZN"] == ["Amazon.com, Inc.", "Amazon", "Amazon.com"]


def test_shared_alias_belongs_to_the_first_symbol(dictionary):
    owners = {r["alias"]: r["symbol"] for r in alias_owner(dictionary).collect()}
    assert owners["Google"] == "GOOGL" and owners["Inc."] == "AMZN"
    assert alias_index(dictionary).filter("alias = 'Google'").count() == 2


def test_similarity():
    same = fuzzy.token_set_similarity
    assert same("Apple", "Apple Inc") == 100 and same("b a a", "a b") == 100
    assert same("", "x") == 0 and same("Inc", "Inc.") == pytest.approx(100 * 6 / 7)
    assert same("Microsft", "Microsoft") == pytest.approx(100 * 16 / 17)
    assert same("Foo Inc.", "Bar Inc.") == pytest.approx(100 - 100 * 4 / 12)


def _alias_order():
    owner = {}
    for symbol, name, aliases in TICKER_ROWS:
        for alias in [name, *aliases.split(";")]:
            owner.setdefault(alias, symbol)
    return owner


def _best(mention):
    best, top = None, -1.0
    for alias in _alias_order():
        score = fuzzy.token_set_similarity(mention, alias)
        if score > top:
            best, top = alias, score
    return (best, top, _alias_order()[best]) if top >= 85 else (None, None, None)


def _mentions(n):
    rnd, names, out = random.Random(3), list(_alias_order()), {"", " ", "The", "Inc", "Google Inc"}
    while len(out) < n:
        letters = list(rnd.choice(names))
        for _ in range(rnd.randint(0, 3)):
            letters.insert(rnd.randrange(len(letters) + 1), rnd.choice("aeinrst I"))
            if rnd.random() < 0.5:
                letters.pop(rnd.randrange(len(letters)))
        text = "".join(letters) + rnd.choice(["", "", " Inc.", " Group", " Google"])
        out.add(" ".join(reversed(text.split())) if rnd.random() < 0.2 else text)
    return sorted(out)


@pytest.mark.parametrize("part_letters", [fuzzy.PART_LETTERS, 40])
def test_fuzzy_match_is_exact(spark, dictionary, part_letters):
    mentions = _mentions(300)
    df = spark.createDataFrame([(m,) for m in mentions], "mention string")
    found = fuzzy.fuzzy_match(df, dictionary, part_letters=part_letters).collect()
    assert {r["mention"]: (r["alias"], r["score"], r["symbol"]) for r in found} == {m: _best(m) for m in mentions}


ARTICLES = [
    ("cash", "t", "x $AAPL y", ["host:a.com"]),
    ("title", "Apple up", "b", []),
    ("title+host", "apple", "b", ["host:apple.com", "host:ir.foo.com"]),
    ("many", "metadata inc. google", "$GOOGL $GOOG $TSLA", ["host:aapl.com"]),
    ("investor", "none", "none", ["host:investor.x"]),
    ("null", None, None, None),
    ("mixed", "ms corp msft $MSFT", "Amazon.com rose", ["host:www.msft.com"]),
]
SCHEMA = "id string, title string, body string, hints array<string>"


def _scores(title, body, hints, matched=()):
    import re

    cash = set(re.findall(r"\$([A-Z]{1,5})\b", f"{title or ''} {body or ''}"))
    low, out = (title or "").lower(), {}
    for symbol, name, aliases in TICKER_ROWS:
        s = 4.0 if symbol in cash else 0.0
        if symbol.lower() in low or any(a.lower() in low for a in [name, *aliases.split(";")]):
            s += 1.5
        hosts = [h[5:] for h in hints or [] if h.startswith("host:")]
        if any("ir." in h or "investor" in h or (h.endswith(".com") and symbol.lower() in h) for h in hosts):
            s += 1.0
        out[symbol] = s + list(matched).count(symbol)
    return out


def test_scores(spark, dictionary):
    df = spark.createDataFrame(ARTICLES, SCHEMA)
    got = {r["id"]: {s["symbol"]: s["score"] for s in r["ticker_scores"]} for r in resolve.score_tickers(df, dictionary).collect()}
    assert got == {i: {k: v for k, v in _scores(t, b, h).items() if v > 0} for i, t, b, h in ARTICLES}
    parted = resolve.score_tickers(df, dictionary, part_letters=30).collect()
    assert {r["id"]: {s["symbol"]: s["score"] for s in r["ticker_scores"]} for r in parted} == got


@pytest.mark.parametrize("min_score,max_tickers", [(2.0, 5), (1.0, 3), (3.5, 5)])
def test_whole_and_parted_dictionary(spark, dictionary, min_score, max_tickers):
    df = spark.createDataFrame(ARTICLES, SCHEMA)
    expected = {}
    for i, t, b, h in ARTICLES:
        ranked = sorted(_scores(t, b, h).items(), key=lambda kv: -kv[1])
        expected[i] = [s for s, v in ranked if v >= min_score and v > 0][:max_tickers]
    for part_letters in (resolve.PART_LETTERS, 30, 1):
        out = resolve.resolve_tickers(df, dictionary, min_score, max_tickers, part_letters)
        assert {r["id"]: r["tickers"] for r in out.collect()} == expected


def test_mentions_add_up(spark, dictionary):
    rows = [("a", "", "Google said. Alphabet, Google Inc and Reuters agreed.", []), ("b", "apple", "Nothing else", [])]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"source": F.lit("s"), "url": F.lit("u"), "published_ts": F.lit(0)})
    out = {r["id"]: r for r in enrich(df, dictionary).collect()}
    # Three mentions of GOOGL's aliases; GOOG shares them and gets nothing.
    assert out["a"]["tickers"] == ["GOOGL"] and out["a"]["entities"] == ["Google", "Alphabet", "Google Inc", "Reuters"]
    assert out["b"]["tickers"] == [] and (out["b"]["source"], out["b"]["url"]) == ("s", "u")
    known = enrich(df, dictionary, resolve.CapitalizedRuns(["Reuters", "agreed"])).filter("id = 'a'").first()
    assert known["entities"] == ["Google", "Alphabet", "Google Inc", "Reuters", "agreed"]


def test_row_local(spark, dictionary, plan):
    df = spark.createDataFrame(ARTICLES, SCHEMA).withColumn("entities", F.array(F.lit("Apple")))
    text = plan(resolve.resolve_tickers(resolve.match_entities(df, dictionary), dictionary))
    assert "Exchange" not in text and "Join" not in text and "ArrowEvalPython" in text


def test_patterns_are_found_by_one_pass():
    rnd = random.Random(1)
    for _ in range(200):
        needles = ["".join(rnd.choice("abc") for _ in range(rnd.randrange(5))) for _ in range(rnd.randrange(12))]
        texts = ["".join(rnd.choice("abcd\u00e9\U0001f600") for _ in range(rnd.choice([0, 1, 3, 40, 1300]))) for _ in range(rnd.randrange(8))]
        at, which = PatternTable(needles).find(texts)
        found = list(zip(at.tolist(), which.tolist()))
        assert len(found) == len(set(found))
        assert set(found) == {(i, j) for i, t in enumerate(texts) for j, n in enumerate(needles) if n and n in t}


def test_best_alias_at_every_cutoff():
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcde") for _ in range(rnd.randrange(1, 6))) for _ in range(25)] + ["Inc", "Corp"]
    for _ in range(60):
        aliases = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(4))), f"S{i}") for i in range(rnd.randrange(30))]
        index = fuzzy.AliasIndex(aliases)
        for cutoff in (0, 20, 50, 66, 70, 85, 90, 100):
            mention = " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 4))).replace("a", rnd.choice("abcdef"), 1)
            best, top = None, -1.0
            for place, alias, symbol in aliases:
                score = fuzzy.token_set_similarity(mention, alias)
                if score >= cutoff and score > top:
                    best, top = (alias, score, symbol, place), score
            assert index.best(mention, cutoff) == best


def test_mentions_have_no_bound(spark):
    long_name = "The Great Northern And Southern Railway Steamship Land Timber Mining Company"
    many = " ".join(f"Word{i}" for i in range(20_000))
    rows = [f"{long_name} said", "x a.b.C.D.e.F.G-H.i said iPhone Pro", "Acme Inc. Foo Ltd. Then Co.uk and Sinc.", many, "A B C  D\u00e9 E\nF", "Mac\x01Donald", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "n int, t string")
    found = [r[0] for r in df.orderBy("n").select(resolve.CapitalizedRuns().mentions(F.col("t"))).collect()]
    assert found[0] == [long_name]
    assert found[1] == ["C.D.e.F.G-H.i", "Phone Pro"]
    assert found[2] == ["Acme Inc. Foo Ltd. Then Co.uk", "Sinc"]
    assert found[3] == [many] and found[4] == ["A B C", "D", "E", "F"] and found[5] == ["Mac", "Donald"] and found[6] == []


def test_names_are_whole_words_longest_first(spark):
    names = ["Apple", "Apple Inc", "Alphabet Inc. Class A", "de la Rue", "A&B"]
    trie = NameTrie(names)
    assert trie.find("Apple Inc. Pineapple Apple-x Apple; Alphabet Inc. Class A, Alphabet Inc. Class, de la Rue A&B A&Bc") == [
        "Apple Inc", "Apple", "Alphabet Inc. Class A", "de la Rue", "A&B"]
    df = spark.createDataFrame([("the de la Rue of Apple, de la Rue",), (None,)], "t string")
    found = [r[0] for r in df.select(resolve.CapitalizedRuns(names).mentions(F.col("t"))).collect()]
    assert found[0] == ["Rue", "Apple", "Rue", "de la Rue"]


def test_tens_of_thousands_of_symbols(spark, tmp_path):
    """The same answers at 50 000 symbols, in a batch and in a stream, as from the symbols that matter."""
    symbol = lambda i: "Q" + "".join("BCDFGHJKLMNPRSTVWXZ"[i // 19**k % 19] for k in range(4))
    entries = [(symbol(i), f"Firm{i} Ltd", f"Brand{i}x;Zug{i}") for i in range(50_000)]
    wanted = [7, 123, 4_567, 49_999]
    rows = [(str(i), f"${symbol(i)} and Brand{i}x news", f"about ${symbol(7)}", [f"Firm{i} Ltdd", "Nobody"]) for i in wanted]
    df = spark.createDataFrame(rows, "id string, title string, body string, entities array<string>").withColumn("hints", F.array(F.lit("host:ir.x")))
    large = tickers_from_rows(spark, entries)
    found = resolve.resolve_tickers(resolve.match_entities(df, large), large)
    local = {r.id: r.tickers for r in found.collect()}
    assert all(set(local[str(i)]) >= {symbol(i), symbol(7)} for i in wanted)
    few = tickers_from_rows(spark, [e for i, e in enumerate(entries) if i in wanted])
    few_found = {r.id: [s for s in r.tickers] for r in resolve.resolve_tickers(resolve.match_entities(df, few), few).collect()}
    known = {symbol(i) for i in wanted}
    assert {k: [s for s in v if s in known][:2] for k, v in local.items()} == {k: v[:2] for k, v in few_found.items()}
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = resolve.resolve_tickers(resolve.match_entities(stream, large), large).writeStream.format("memory").queryName("large_symbols").trigger(availableNow=True)
    query.option("checkpointLocation", str(tmp_path / "state")).start().awaitTermination(120)
    assert {r.id: r.tickers for r in spark.table("large_symbols").collect()} == local


def test_repeated_ids_stay_apart(spark, dictionary):
    rows = [(1, "$AAPL up", ["Apple"]), (1, "$MSFT up", ["Microsoft", "Apple"]), (1, "$AAPL up", ["Apple"]), (None, "$NVDA", []), (2, None, None)]
    df = spark.createDataFrame(rows, "id long, title string, entities array<string>").withColumn("body", F.lit("")).withColumn("hints", F.array().cast("array<string>"))
    for part_letters in (resolve.PART_LETTERS, 30):
        out = resolve.resolve_tickers(df, dictionary, part_letters=part_letters)
        assert out.columns == [*df.columns, "tickers"]
        assert sorted((str(r.id), r.tickers) for r in out.collect()) == [("1", ["AAPL"]), ("1", ["AAPL"]), ("1", ["MSFT"]), ("2", []), ("None", ["NVDA"])]


def test_found_symbols_are_held_in_steps():
    """Very many symbols in every title of a batch: memory follows the step, not the batch; results do not."""
    letters = "etaoin"
    symbols = [a + b + c for a in letters for b in letters for c in ["", *letters]]
    table = resolve.SymbolTable([(s.upper(), i, s, []) for i, s in enumerate(symbols)])
    rnd = random.Random(5)
    titles = pa.array([None if i % 500 == 0 else "".join(rnd.choices(letters, k=1_500)) for i in range(4_000)])
    none = pa.array([[]] * len(titles), pa.list_(pa.string()))
    investor = pa.array([i % 2 == 0 for i in range(len(titles))])
    tracemalloc.start()
    found = table.scores(titles, none, investor, none, none, 2.0, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150_000_000
    assert len(found) == len(titles)
    for i in (0, 1, 2, 998, 2_222, 3_998, 3_999):
        title = titles[i].as_py() or ""
        best = [s.upper() for s in symbols if s in title][:3] if i % 2 == 0 else []
        assert [f["symbol"] for f in found[i].as_py()] == best


def test_parts_are_no_broadcasts(spark, monkeypatch):
    """A dictionary of many parts gives the same lists as one of one part, and no worker keeps all parts."""
    rows = [(f"S{i}", f"Name {i} Corp", f"alias{i % 7};other {i}") for i in range(40)]
    tickers = tickers_from_rows(spark, rows)
    text = [(i, f"$S{i % 40} Name {i % 11} Corp alias{i % 5}", ["host:ir.x.com"] if i % 4 == 0 else ["host:www.s3.com"]) for i in range(200)]
    articles = spark.createDataFrame(text, "id int, title string, hints array<string>").withColumn("body", F.lit("$S1 or $S39"))
    for most in (None, 3):
        one = {r["id"]: r["s"] for r in articles.select("id", resolve.ticker_scores(articles, tickers, 1.0, most).alias("s")).collect()}
        with monkeypatch.context() as patch:
            patch.setattr(type(spark.sparkContext), "broadcast", lambda *_: pytest.fail("a part was broadcast"))
            many = articles.select("id", resolve.ticker_scores(articles, tickers, 1.0, most, part_letters=60).alias("s")).collect()
        assert {r["id"]: r["s"] for r in many} == one and max(map(len, one.values())) == (most or 40)


def test_mentions_are_matched_in_steps(spark, monkeypatch):
    """Slices of bounded size hold all lists in order, null and long ones too, and matching does not depend on them."""
    lists = pa.array([["a"] * 3, None, [], ["b"] * 50, ["c"], None, ["d"] * 9, ["e"] * 2], pa.list_(pa.string()))
    monkeypatch.setattr(fuzzy, "_STEP_MENTIONS", 10)
    parts = list(fuzzy._steps(lists))
    assert pa.concat_arrays(parts).equals(lists) and len(list(fuzzy._steps(lists.slice(0, 0)))) == 1
    assert all(len(p) == 1 or len(p.flatten()) <= 10 for p in parts) and len(parts) < len(lists)
    names = list(_alias_order())
    rows = [(i, None if i % 5 == 0 else [names[(i * j) % len(names)] + "x" * (i % 2) for j in range(i % 7)]) for i in range(60)]
    mentions = spark.createDataFrame(rows, "id int, entities array<string>").coalesce(1)
    dictionary = tickers_from_rows(spark, TICKER_ROWS)
    got = {r["id"]: r["matched"] for r in resolve.match_entities(mentions, dictionary).collect()}
    wanted = {i: [hit for hit in (_best(m)[2] for m in found or []) if hit] for i, found in rows}
    assert got == {i: wanted[i] for i, _ in rows}


def _plain_best(rows, title, hosts, cashtags, matched, min_score, most):
    investor, company = any("ir." in h or "investor" in h for h in hosts), [h for h in hosts if h.endswith(".com")]
    listed = []
    for symbol, ord_, low, names in rows:
        score = 4.0 * (symbol in cashtags) + 1.5 * (low in title or any(n in title for n in names)) + 1.0 * matched.count(symbol)
        score += 1.0 * (investor or any(low in h for h in company))
        if score >= min_score:
            listed.append((-score, ord_, symbol))
    return [(s, o, -n) for n, o, s in sorted(listed)[:most]]


def test_a_large_dictionary_is_searched_in_one_pass(spark, monkeypatch):
    """Symbols and names beyond the first part are found whatever the number of parts, and no automaton is made of them."""
    rnd = random.Random(9)
    word = lambda a, b: "".join(rnd.choice("ABCé") for _ in range(rnd.randrange(a, b)))
    entries = {word(2, 7): (word(3, 9), word(0, 5)) for _ in range(400)}
    rows = [(s, i, s.lower(), [x for x in dict.fromkeys([n.lower(), a.lower()]) if x]) for i, (s, (n, a)) in enumerate(entries.items()) if s == s.upper()]
    tickers = spark.createDataFrame([(s, i, names) for s, i, _, names in rows], "symbol string, ord int, aliases array<string>")
    monkeypatch.setattr(resolve, "FIRST_SYMBOLS", 5)
    symbols = [s for s, *_ in rows]
    odd = ["www.%s.com" % "".join(rnd.choice("abcé") for _ in range(6)), "ir.x.com", "investor.abc.org", "x.org"]
    articles = []
    for i in range(150):
        title = " ".join(word(1, 9) for _ in range(rnd.choice([0, 1, 2, 30]))) if i % 10 else None
        articles.append((i, title, [rnd.choice(odd) for _ in range(rnd.randrange(3))], [rnd.choice(symbols) for _ in range(rnd.randrange(3))], [rnd.choice([*symbols, "none"]) for _ in range(rnd.randrange(4))]))
    df = spark.createDataFrame([(i, t, "".join(f" ${c}" for c in cash if c.isascii() and len(c) <= 5), [f"host:{h}" for h in hosts], m) for i, t, hosts, cash, m in articles], "id int, title string, body string, hints array<string>, matched array<string>")
    # One file and one automaton at most are made for each part: now only the index.
    made = resolve.SymbolTable
    monkeypatch.setattr(resolve, "SymbolTable", lambda *_: pytest.fail("an automaton was made"))
    got = {}
    for part_letters in (60, 900):
        for min_score, most in ((2.0, 5), (1.5, 2), (2.5, 40), (4.0, 3)):
            column = resolve.ticker_scores(df, tickers, min_score, most, part_letters)
            for r in df.select("id", resolve.extract_cashtags(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), "body")).alias("c"), column.alias("s")).collect():
                _, title, hosts, _, matched = articles[r["id"]]
                assert [tuple(x) for x in r["s"]] == [(n, o, s) for s, o, n in _plain_best(rows, (title or "").lower(), hosts, r["c"], matched, min_score, most)], (r["id"], min_score)
                got[min_score] = got.get(min_score, 0) + len(r["s"])
    assert all(n > 50 for n in got.values()) and len(got) == 4
    # With all symbols asked for, the parts' automata still answer.
    monkeypatch.setattr(resolve, "SymbolTable", made)
    assert df.select(resolve.ticker_scores(df, tickers, 1.0, 3, 900).alias("s")).count() == 150


def test_windows_of_texts_of_any_length():
    from newsloom.operators import symbol_index as index

    rnd = random.Random(6)
    patterns = sorted({"".join(rnd.choice("abé") for _ in range(rnd.randrange(1, 9))) for _ in range(60)})
    bits = index.bit_field(len(patterns))
    hashes = index.SpanHash().whole(pa.array(patterns))
    index.set_bits(bits, hashes)
    windows = index.Windows(bits, sorted({len(p.encode()) for p in patterns}))
    texts = ["".join(rnd.choice("abcé") for _ in range(rnd.choice([0, 1, 7, 50, 900]))) for _ in range(40)]
    for block in (16, index.BLOCK):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(index, "BLOCK", block)
            at, found = windows.find([t.encode() for t in texts])
            assert (index.SpanHash().whole(pa.array(patterns)) == hashes).all()
        pairs = set(zip(at.tolist(), found.tolist()))
        assert all((p in t) == ((i, h) in pairs) for i, t in enumerate(texts) for p, h in zip(patterns, hashes.tolist()))
