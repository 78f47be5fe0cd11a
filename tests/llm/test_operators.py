"""Each operator against a brute-force version, and on awkward tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe, components, decontam, exact_dedup, language_id, minhash, pii, queries, sharding, shared, suffix_dedup, token_counts, url_filter

DATA = "/root/testdata/sf0.001"
SPACE = "[\x20\x09-\x0d]"
R = random.Random(11)
VOCABULARY = [f"w{i}" for i in range(2000)]
ODD = ["", " ", "\n\t", "a", "a b", "a  b\n", "é", "İI ıi", "<|endoftext|>", "x<|endoftext|> y <|ENDOFTEXT|>", "'s 't don't", "a\u00a0b\u2003c", "e\u0301 \u0301x", "tab\there\r\n\r\nend  ", "日本語のテキスト", "🙂🙂 🙂", "x" * 5000, "ab " * 3000, "\u0000nul", "a\x1cb\x85c"]


@pytest.fixture(scope="module")
def rows():
    t = pq.read_table(f"{DATA}/documents.parquet").to_pydict()
    out = list(zip(t["doc_id"], t["text"]))
    out += [(10_000 + i, x) for i, x in enumerate(ODD)] + [(20_000, None), (20_001, None)]
    base = [R.choice(VOCABULARY) for _ in range(150)]
    chain = list(base)
    for i in range(25):
        chain[R.randrange(150)] = R.choice(VOCABULARY)
        out.append((30_000 + i, " ".join(chain)))
        other = list(base)
        for _ in range(R.randrange(1, 10)):
            other[R.randrange(150)] = R.choice(VOCABULARY)
        out.append((31_000 + i, " ".join(other)))
    out += [(40_000 + i, "  ".join(base)) for i in range(40)]
    R.shuffle(out)
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5).withColumn("key", F.lit(1)).withColumn("digest", F.lit("x")).withColumn("rank", F.lit(None).cast("int"))


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def test_token_counts(docs, rows, tmp_path):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {d: (len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for d, x in rows}
    cache = f"file://{tmp_path}/cache"
    for _ in range(2):
        got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(docs, "word_bpe_49k.json", cache).collect()}
        assert got == {d: (*w, w[1] > 2048) for d, w in want.items()}
        stored = docs.sparkSession.read.parquet(cache)
        assert stored.count() == stored.select("digest").distinct().count()


def test_bpe(docs, rows):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r["doc_id"]: r for r in bpe.encode_digests(docs, "byte_bpe_50k.json").collect()}
    for d, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert got[d]["n_tokens"] == len(ids), (d, x[:50])
        assert got[d]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[d]["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(docs, "byte_bpe_50k.json"), "byte_bpe_50k.json").collect()}
    assert back == {d: x or "" for d, x in rows}


def test_bpe_of_any_characters(spark):
    """Both libraries' sides and what lies between them; repeated rows, clashing columns, an empty table."""
    r = random.Random(9)
    alphabets = ["ab AB'st\n\t \r", "a1 ²½ª٣ '", "éÉøß ñ'ſ×÷", "a\u00a0\u2003\u0085\x1c \n", "–—“”…€ a.", "日本 ж🙂 a", "<|endoftext|> <", "\ud7ff\uffff\U0010ffffa "]
    texts = ["".join(r.choice(a if r.random() < 0.9 else r.choice(alphabets)) for _ in range(r.randrange(0, 60))) for a in alphabets for _ in range(150)] + ["é " * 100_000]
    table = spark.createDataFrame(list(enumerate(texts)) * 2, "doc_id bigint, text string").withColumn("ids", F.lit(1)).withColumn("decoded", F.lit(1))
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = bpe.encode(table, "byte_bpe_50k.json").collect()
    assert len(got) == 2 * len(texts) and bpe.codec("byte_bpe_50k.json").fast
    for row in got:
        ids = t.encode(texts[row["doc_id"]], add_special_tokens=False).ids
        assert np.frombuffer(row["ids"], "<u4").tolist() == ids, texts[row["doc_id"]]
        assert bytes(row["decoded"]).decode() == t.decode(ids, skip_special_tokens=False)
    assert bpe.encode(table.where("false"), "byte_bpe_50k.json").count() == 0


def test_bpe_cuts_lie_in_no_token():
    c = bpe.codec("byte_bpe_50k.json")
    inside = {(a, b) for token in c.bytes_of for a, b in zip(token, token[1:])}
    assert not any(c.cut[a << 8 | b] for a, b in inside) and c.cut.sum() > 1000


def site(url):
    if url is None or "://" not in url:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
    return re.sub("[A-Z]", lambda c: c.group().lower(), m[1]), m[2]


URLS = [None, "", "no scheme.com/en/", "http://com/x", "https://EXAMPLE.com/en/1?q#f", "http://www.example.com/en/", "http://a.www.example.com/en/z", "x://notexample.com/en/", "http://example.com/EN/", "http://e.net/es/", "http://e.net/fr", "http://e.net/fr/a", "http://net/es/", "http://example.com?x=/en/", "a://b://com/", "http://spam-farm.example.org/de/", "http://my-spam-farm.org/", "http://exämple.com/en/", "http://u@h.com:80/en/", "http://.com/"]


BAD_URLS = ["http://m.casino-win.org/en/", "http://www.my-poker.org/x", "http://help.org/casino/", "http://help.org/casinos/", "http://casino.gamcare.org.uk/", "http://adult.org/sex-education/", "http://ads.x.org/banner", "http://x.org/banners/a.gif", "http://x.org/banners/a.gifs", "http://x.org/track/click", "http://x.org/track/clicks", "http://track.x.org/a/open/", "http://pixel.x.org/docs/", "http://metrics.x.org/docs/", "http://NotACasino.org/", "http://help.org/Casino/", "http://HELP.org/CASINO", "http://x.org/counter.php\n", "http://x.org/COUNTER.PHP", "http://x.org/\u212aeygen/"]


def test_urls(spark, monkeypatch):
    urls = URLS + BAD_URLS + pq.read_table(f"{DATA}/pages.parquet").to_pydict()["url"] * 2 + ["http://long.org/" + "casino/" * 30_000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumn("host", F.lit(3)).withColumn("tokens", F.lit("x"))
    rules = queries.url_rules()
    patterns = [(r, re.compile(url_filter.regex(r.pattern, "\\Z"))) for r in url_filter.read_rules()]

    def judge(url):
        host, path = site(url)
        fit = [(h + p, v) for h, p, v in queries.SITE_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fit, key=lambda r: len(r[0]), default=None)
        found = [r for r, x in patterns if x.search(re.sub("[A-Z]", lambda c: c.group().lower(), host + path))]
        bad = {r.verdict for r in found} == {"block"}
        return host, path, rule and rule[0], rule[1] if rule else "block" if bad else "allow", ",".join(sorted(r.name for r in found))

    want = {i: judge(u) for i, u in enumerate(urls)}
    by_url = {u: want[i] for i, u in enumerate(urls)}
    assert [u for u in BAD_URLS if by_url[u][3] == "block"] == [BAD_URLS[i] for i in (0, 1, 2, 6, 7, 9, 11, 12, 15, 16, 18)]
    for most in (url_filter.BROADCAST_RULES, 0):
        monkeypatch.setattr(url_filter, "BROADCAST_RULES", most)
        judged = url_filter.judge(pages, rules)
        rows = judged.collect()
        assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"], r["patterns"]) for r in rows} == want and len(rows) == len(urls)
        # a URL's tokens fetch few of the rules, and all that fit
        assert sum(r["n_candidates"] for r in rows) < 0.05 * len(rows) * len(rules)
        hits = {r["pattern"]: r["urls"] for r in url_filter.rule_hits(judged).collect()}
        assert hits == Counter(p for w in want.values() for p in w[4].split(",") if p)
    assert url_filter.judge(pages.where("false"), rules).count() == 0
    assert url_filter.judge(pages, []).where("verdict = 'allow' and n_candidates = 0").count() == len(urls)


def test_url_tokens_are_whole():
    assert url_filter.tokens("||ads.example^") == ["ads", "example"] and url_filter.tokens("foo*bar-baz") == []
    assert url_filter.tokens("/banner/*/img|") == ["banner", "img"] and url_filter.tokens("track") == []
    assert re.search(url_filter.regex("||ads.example^", "\\Z"), "x.ads.example/a") and not re.search(url_filter.regex("||ads.example^", "\\Z"), "ads.examples/a")


@pytest.mark.parametrize("pattern, yes, no", [
    ("||ads.", "x.ads.org/", "xads.org/"), ("|ads.", "ads.org/", "x.ads.org/"), ("/a.gif|", "h.org/a.gif", "h.org/a.gifs"), ("/a^", "h.org/a", "h.org/ab"),
    ("/a^", "h.org/a/b", "h.org/a-b"), ("/a*b/", "h.org/a/x/b/", "h.org/a/x/b"), ("-a+b-", "h.org/-a+b-", "h.org/-aab-"), ("a[b", "h.org/a[b", "h.org/ab"),
])
def test_url_syntax(pattern, yes, no):
    assert re.search(url_filter.regex(pattern, "\\Z"), yes) and not re.search(url_filter.regex(pattern, "\\Z"), no)
    assert re.search(url_filter.regex(pattern.upper(), "\\Z"), yes) and not re.search(url_filter.regex(pattern, "\\Z"), no + "\n")
    assert set(url_filter.tokens(pattern)) <= set(re.findall("[a-z0-9]+", yes))


def test_url_rule_lists(tmp_path):
    (tmp_path / "list.txt").write_text("! a comment\n@forms ||{}. ^{}^\nfoo\n\nbar\n@forms\n/x^\n@@/y^\n/x^\n")
    got = [(r.name, r.pattern, r.verdict) for r in url_filter.read_rules(tmp_path / "list.txt")]
    assert got == [(p, p, "block") for p in ("||foo.", "^foo^", "||bar.", "^bar^", "/x^")] + [("@@/y^", "/y^", "allow")]
    assert all(url_filter.tokens(r.pattern) for r in url_filter.read_rules()) and len(url_filter.read_rules()) > 300


def test_language_id(spark, docs, empty):
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language_id.learn(table)
    got = language_id.predict(table, model).join(table.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    late = [r for r in got if r["held_out"]]
    assert np.mean([r["lang_pred"] == r["lang"] for r in late]) > 0.95 and all(0 <= r["score"] <= 1 for r in got)
    odd = {r["doc_id"]: r for r in language_id.predict(docs, model).collect()}
    assert odd[20_000]["lang_pred"] == "und" and odd[20_000]["score"] == 0 and odd[10_001]["lang_pred"] == "und"
    assert len(odd) == docs.count() and language_id.predict(empty, model).count() == 0
    assert language_id.learn(table.where("false")) is None
    assert {r["lang_pred"] for r in language_id.predict(table, None).collect()} == {"und"}
    kept = language_id.keep_identified(table, model)
    assert kept.columns == table.columns and kept.count() > 0.98 * table.count()


def test_forward_backward_is_exact():
    r = np.random.default_rng(0)
    for lengths in ([5, 1, 70, 33], [64, 32, 31], [1]):
        e, move = r.normal(size=(sum(lengths), 3)) * 2, r.normal(size=(3, 3))
        got, _ = language_id.posteriors(e, np.array(lengths), move, block=8)
        at, step = 0, np.exp(move)
        for n in lengths:
            x = np.exp(e[at : at + n])
            ahead = [np.full(3, 1 / 3) @ step * x[0]]
            for i in range(1, n):
                ahead.append((ahead[-1] @ step) * x[i])
            behind = [np.ones(3)]
            for i in range(n - 1, 0, -1):
                behind.insert(0, step @ (x[i] * behind[0]))
            want = np.array(ahead) * np.array(behind)
            assert np.allclose(want / want.sum(1, keepdims=True), got[at : at + n], atol=1e-6)
            at += n


def test_switched_words_are_told_apart(spark):
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language_id.learn(table)
    texts = dict(table.where("lang in ('en', 'de')").groupBy("lang").agg(F.max_by("text", F.length("text"))).collect())
    words = [language_id.WORD.findall(texts[k].lower())[:60] for k in ("en", "de", "en")]
    p, _ = language_id.posteriors(model.word_scores(sum(words, [])), np.array([180]), model.move)
    best = [model.labels[i] for i in p.argmax(1)]
    assert np.mean([x == y for x, y in zip(best, ["en"] * 60 + ["de"] * 60 + ["en"] * 60)]) > 0.9


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    out, n = [], []
    for kind, p in PATTERNS.items():
        found = []
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            found += [f"{kind}:{m.start()}:{m.end()}"] * ok
        n.append(len(found))
        out += found
    return (*n, hashlib.sha256(",".join(out).encode()).hexdigest()), out


def test_personal_data(spark, docs, rows, empty):
    alphabets = ["a.@-1+ 2é(0)%_9x 4\n\ue000", "4539578763621486 -.+", "ab@.-c"]
    more = [(50_000 + 1000 * j + i, "".join(R.choice(a) for _ in range(R.randrange(0, 100)))) for j, a in enumerate(alphabets) for i in range(500)]
    more += [(60_000, "1 " * 30_000), (60_001, "a." * 30_000 + "@b"), (60_002, "x@" + "b." * 20_000 + "c"), (60_003, "a" * 100_000 + " @"), (60_004, "4539 5787 6362 1486 bob@x.org %x@y.z a@b.c@d.e 🙂 +1 (988) 555-2485 1.2.3.4.5.6.7.8")]
    near = lambda: " ".join("filler" + R.choice("abcdefghijkl") for _ in range(5))
    more += [(70_000 + i, f"{near()} zanzibarus bob.smith@corp.example.com {near()}") for i in range(6)]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id bigint, text string"))
    got = {r["doc_id"]: r for r in pii.find(table).collect()}
    for d, x in [*rows, *more]:
        want, spans = base(x)
        r = got[d]
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) == want, (d, (x or "")[:80])
        assert [s for s in r["spans"].split(",") if s and not s.startswith("term:")] == spans
    assert all("term:" in got[70_000 + i]["spans"] for i in range(6))
    assert all(r["n_terms"] == 0 for d, r in got.items() if d < 20_000)
    assert pii.find(empty).count() == 0
    clean = {r["doc_id"]: r["text"] for r in pii.generalise(table.where("doc_id >= 60004 or doc_id < 100")).collect()}
    assert "[card] [email]" in clean[60_004] and "bob" not in clean[60_004]


def test_every_letter_of_a_run_is_looked_at():
    """What stands in the middle of a long run moves its score, by as much as its n-grams weigh."""
    weights = np.random.default_rng(5).normal(size=(language_id.BUCKETS, 3))
    model = language_id.Model(["a", "b", "c"], weights, np.zeros((3, 3)), {})
    for size in (30, 400_000):
        words = ["x" * size + middle + "x" * size for middle in ("", "q", "日本語")] + ["short", "words"]
        got = model.word_scores(words)
        q, x = (model.word_scores([f"xxxx{m}xxxx"]) - model.word_scores(["xxxxxxxx"]) for m in ("q", ""))
        assert not x.any() and np.abs(got[1] - got[0] - q[0]).max() < 1e-2 + 1e-6 * size
        assert np.abs(got[2] - got[0]).max() > 0.1
        assert (got[3:] == model.word_scores(["short", "words"])).all()


def test_terms_are_counted_over_distinct_texts(spark):
    """A copied context must not make its term look common."""
    other = [(i, f"plain{'abcdefghij'[i % 10]} words{'abcdefghij'[i // 10]} without anything to hide") for i in range(100)]
    held = [(200 + i, f"{a} zanzibarus bob.smith@corp.example.com {b}") for i, (a, b) in enumerate([("alpha", "bravo"), ("charlie", "delta"), ("echo", "foxtrot")])]
    copies = [(300 + i, held[0][1]) for i in range(60)]
    for extra in ([], copies):
        table = spark.createDataFrame([*other, *held, *extra], "doc_id bigint, text string")
        got = {r["doc_id"]: r for r in pii.find(table).collect()}
        assert all(got[d]["n_terms"] == 1 and "term:" in got[d]["spans"] for d, _ in [*held, *extra])
        assert all(got[d]["n_terms"] == 0 for d, _ in other)
    # copies alone are one context, and no term is disclosed by them
    got = pii.find(spark.createDataFrame([*other, *copies], "doc_id bigint, text string"))
    assert got.agg(F.sum("n_terms")).first()[0] == 0


def test_terms_lie_within_eight_words_however_long(spark):
    """Words of any length lie between a term and its entity; a word's end is no word."""
    other = [(i, f"plain{'abcdefghij'[i % 10]} words{'abcdefghij'[i // 10]} without anything to hide") for i in range(100)]
    mail = "bob.smith@corp.example.com"
    near, far, cut = [], [], []
    for i, c in enumerate("abc"):
        for size in (60, 3000):
            k = 10 * i + size
            long = [f"{c}{j}/" * size for j in range(6)]
            near += [(1000 + k, " ".join(["zanzibarus", *long, c, mail])), (5000 + k, " ".join([mail, c, *long, "zanzibarus"]))]
            far += [(10_000 + k, " ".join(["zanzibarus", *long, c, c, mail])), (15_000 + k, " ".join([mail, c, c, *long, "zanzibarus"]))]
        cut.append((20_000 + i, "zanzibarus" * 20 + f"{c} {mail}"))
    for rows, n in ((near, 1), (far, 0), (cut, 0)):
        got = {r["doc_id"]: r for r in pii.find(spark.createDataFrame([*other, *rows], "doc_id bigint, text string")).collect()}
        assert [got[d]["spans"].count("term:") for d, _ in rows] == [n] * len(rows)


def brute_terms(rows, near=8, alpha=0.8, support=3):
    """Per row its term spans, by loops over distinct texts."""
    import regex

    texts = {x or "" for _, x in rows}
    of_word = lambda w: (m := regex.match(r"^[^\p{L}]*([\p{L}]{4,})[^\p{L}]*$", w.lower())) and m[1]
    split = lambda t: re.findall("[^\x20\x09-\x0d]+", t)
    value = {"email": str.lower, "ip": str, "card": lambda v: re.sub("[ -]", "", v), "phone": lambda v: re.sub("[^0-9]", "", v)}
    part = {"email": lambda v: v.split("@")[-1], "ip": lambda v: ".".join(v.split(".")[:2]), "card": lambda v: v[:6], "phone": lambda v: v[:-4]}
    holds, contexts, entity_texts, entities = {}, {}, {}, {}
    n_term = Counter(t for x in texts for t in {of_word(w) for w in split(x)} if t)
    for x in texts:
        for kind, a, b in (s.split(":") for s in base(x)[1]):
            own = value[kind](x[int(a) : int(b)])
            window = tuple(split(x[: int(a)])[-near:] + split(x[int(b) :])[:near])
            for entity in ((kind, own), (f"part of {kind}", part[kind](own))):
                entities.setdefault(x, set()).add(entity)
                entity_texts.setdefault(entity, set()).add(x)
                for t in {of_word(w) for w in window} - {None}:
                    holds.setdefault((entity, t), set()).add(x)
                    contexts.setdefault((entity, t), set()).add(window)
    risky = {}
    for (entity, t), where in holds.items():
        information = -np.log2(len(entity_texts[entity]) / len(texts))
        pmi = np.log2(len(where) * len(texts) / (len(entity_texts[entity]) * n_term[t]))
        if len(contexts[entity, t]) >= support and information > 0 and pmi >= alpha * information:
            risky.setdefault(entity, set()).add(t)
    out = []
    for d, x in rows:
        mine = set().union(*(risky.get(e, set()) for e in entities.get(x or "", ())))
        out.append((d, [f"term:{m.start()}:{m.end()}" for m in regex.finditer(r"\p{L}{4,}", x or "") if m.group().lower() in mine]))
    return out


def test_terms_against_brute_force(spark):
    r = random.Random(17)
    words = [f"{a}{b}{c}" for a in ("plain", "Gloss", "éclat", "tiny-") for b in ("alpha", "beta", "gamma") for c in ("", "ing", "ed,")] + ["a", "of", "77"]
    values = ["bob.smith@corp.example.com", "10.1.2.3", "4539 5787 6362 1486", "+1 (988) 555-2485"]
    near = {v: [f"secret{'abcd'[i]}word", f"(hidden{'abcd'[i]})"] for i, v in enumerate(values)}
    rows = []
    for i in range(400):
        text = [r.choice(words) for _ in range(r.randrange(5, 40))]
        for _ in range(r.choice([0, 0, 1, 2])):
            v = r.choice(values)
            at = r.randrange(len(text))
            text[at:at] = [v, *r.sample([*near[v], r.choice(words)], 2)]
        rows.append((i % 350, " ".join(text)))
    rows += rows[:50] + [(None, None), (None, rows[3][1]), (7, "")]
    got = Counter((x["doc_id"], x["spans"]) for x in pii.find(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    want = Counter((d, ",".join(base(x)[1] + terms)) for (d, x), (_, terms) in zip(rows, brute_terms(rows)))
    assert got == want and sum(len(t) for _, t in brute_terms(rows)) > 50


def test_terms_of_what_values_share(spark):
    """No value occurs twice, but a domain, network, issuer and exchange do, in the given documents with a few more."""
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    r = random.Random(5)
    some = lambda: " ".join(r.choice(VOCABULARY) for _ in range(9))
    for i in range(6):
        for k, (word, v) in enumerate((("Quellenhof", f"user{i}@quelle{i % 2}.example.org"), ("backbone", f"203.77.{i}.{i + 9}"), ("Goldkarte", ("4929000000000", "4929000000010")[i % 2] + f"{i:03d}"), ("Zentrale", f"+49 (30) 901 55{i:02d}"))):
            docs.append((90_000 + 10 * i + k, f"{some()} {word}, {v} {some()}"))
    got = {x["doc_id"]: x["spans"] for x in pii.find(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    want = {d: ",".join(base(x)[1] + terms) for (d, x), (_, terms) in zip(docs, brute_terms(docs))}
    assert got == want
    assert all("term:" in got[90_000 + 10 * i + k] for i in range(6) for k in (1, 3)) and all("term:" in got[90_000 + 10 * i] for i in range(6))
    assert not any("term:" in s for d, s in got.items() if d < 90_000)


def test_very_many_spans_in_one_text(spark):
    """Twenty thousand spans in a text, and rows that share a doc_id."""
    many = "é 10.1.2.3 x " * 20_000
    rows = [(1, many), (1, "mail a@b.c now"), (2, "call +1 (988) 555-2485 or 4539 5787 6362 1486"), (2, None), (None, "nothing")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(x["doc_id"], x["n_ip"], x["n_email"], x["n_phone"], x["n_card"], x["base_sha256"]) for x in pii.find(table).collect()}
    assert got == {(d, n[1], n[0], n[3], n[2], n[4]) for d, x in rows for n in [base(x)[0]]}
    clean = sorted((x["doc_id"] or 0, x["text"]) for x in pii.generalise(table).collect())
    assert clean == sorted([(0, "nothing"), (1, "é [ip] x " * 20_000), (1, "mail [email] now"), (2, "call [phone] or [card]"), (2, "")])


def brute_groups(rows, words, percent):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for d, x in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (x or "").translate(lower))
        sets[d] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = {}
    for d, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(d)
    for d, s in sets.items():
        for e, n in Counter(e for g in s for e in holders[g]).items():
            if e > d and 100 * n >= percent * (len(s) + len(sets[e]) - n):
                a, b = root(d), root(e)
                up[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), root(d)) for d in sets}


@pytest.mark.parametrize("words, percent", [(3, 85), (5, 80)])
def test_near_groups(docs, rows, words, percent):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_groups(docs, words, percent).collect()}
    assert got == brute_groups(rows, words, percent)


def test_near_groups_edges(spark, empty):
    assert minhash.near_groups(empty).count() == 0
    table = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None), (3, "")], "doc_id bigint, text string")
    assert sorted(minhash.keep_one(table).select("doc_id").toPandas()["doc_id"].fillna(-1)) == [-1, 1, 2, 3]


def test_smallest_member_linked_to_a_later_one_only(spark):
    """40 components of ten near copies, each beside a smaller doc_id that is like the last of them alone."""
    r = random.Random(23)
    table = []
    for c in range(40):
        word = [f"c{c}w{i}" for i in range(200)]
        at = r.sample(range(3, 197, 4), 14)

        def changed(places, name):
            return " ".join(f"{name}{i}" if i in places else w for i, w in enumerate(word))

        table.append((100 * c, changed(at[:5], f"c{c}a")))
        table += [(100 * c + 1 + i, changed([x], f"c{c}b")) for i, x in enumerate(at[5:])]
        table.append((100 * c + 50, " ".join(word)))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in minhash.near_groups(spark.createDataFrame(table, "doc_id bigint, text string"), 3, 85).collect()}
    want = brute_groups(table, 3, 85)
    assert all(want[100 * c + 50][1] == 100 * c for c in range(40))
    assert got == want


def test_packed_signatures_estimate():
    r = np.random.default_rng(3)
    common, a, b = (r.integers(0, 1 << 63, n, dtype=np.uint64) for n in (800, 100, 100))
    m = minhash.minima([np.concatenate((common, a)), np.concatenate((common, b))], 512)
    p = minhash.packed(m, 2)
    words = p.shape[1] // 2
    differ = (p[0, :words] ^ p[1, :words]) | (p[0, words:] ^ p[1, words:])
    unequal = sum(int(x & (2**64 - 1)).bit_count() for x in differ.tolist())
    assert abs((1 - unequal / 512 - 0.25) / 0.75 - 0.8) < 0.1


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(200 + i, 200) for i in range(30)] + [(7, 7)]
    got = dict(components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert got == {**{i: 0 for i in range(51)}, **{200 + i: 200 for i in range(1, 30)}, 200: 200}


def test_decontamination(spark, docs, empty):
    bench = spark.createDataFrame([(1, "Alice bought 5 kg of apples for 10 dollars and then Alice ate 2 apples quickly"), (2, "tiny item here"), (3, None), (4, "Carol walks home"), (5, ""), (6, "yes"), (7, "42"), (8, "walks home")], "item_id bigint, text string")
    bought = "Then Bob bought 7 kg of apples for 12 dollars and then {} ate 3 apples quickly"
    table = spark.createDataFrame([(1, f"Some start. {bought.format('Bob')} End"), (2, bought.format("Carl")), (3, "x tiny item here y"), (4, None), (5, "So then Alice bought 5 kg of apples for 10 dollars and then Alice ate 2 apples quickly"), (6, "we saw that Carol walks home"), (7, "apples for ten dollars"), (8, "say Yes now"), (9, "exactly 43 here"), (10, "the 42, then")], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["contaminated"], list(r["items"]), r["kind"]) for r in decontam.decontaminate(table, bench).collect()}
    assert got == {1: (True, [1], "reparameterised"), 2: (False, [], None), 3: (True, [2], "exact"), 4: (False, [], None), 5: (True, [1], "exact"), 6: (True, [4, 8], "exact"), 7: (False, [], None), 8: (True, [6], "exact"), 9: (False, [], None), 10: (True, [7], "exact")}
    assert decontam.decontaminate(empty, bench).count() == 0
    assert decontam.decontaminate(table, bench.where("false")).where("contaminated").count() == 0


UNITS = set(decontam.UNITS)


def plain_tokens(text):
    """(template, value, slot, capitalised) of each token, one character after another."""
    out, last = [], None
    for m in re.finditer(r"[0-9]+(?:[.,][0-9]+)*|[^\W0-9_]+", text):
        word, gap = m.group(), text[last.end() : m.start()] if last else None
        number = word[0].isdigit()
        after_number = bool(out) and out[-1][0] == "<number>" and len(gap) <= 1
        unit = not number and after_number and word.lower() in UNITS
        capital = not number and not unit and word[0].isupper()
        name = capital and gap is not None and not set(gap) & set('.!?\n:;"|')
        out.append(("<number>" if number else "<unit>" if unit else "<name>" if name else word.lower(), word.lower(), number or unit or name, capital))
        last = m
    return out


def plain_windows(text, words, openings):
    """hash key -> list of (place, slot values)."""
    tokens, out = plain_tokens(text), {}
    for i in range(len(tokens) - words + 1):
        w = tokens[i : i + words]
        forms = [w]
        if w[0][0] == "<name>":
            forms.append([(w[0][1], w[0][1], False, True), *w[1:]])
        if openings and i == 0 and w[0][3]:
            forms.append([("<name>", w[0][1], True, True), *w[1:]])
        for f in forms:
            out.setdefault(tuple(t[0] for t in f), set()).add((i, tuple(t[1] for t in f if t[2])))
    return out


def brute_leaks(docs, items, words=5, share=0.8):
    out = {}
    for d, text in docs:
        for k, item in items:
            n = len(plain_tokens(item or ""))
            size = min(words, n)
            if not n or text is None:
                continue
            mine, theirs = plain_windows(item, size, True), plain_windows(text, size, False)
            runs = {}
            for key in mine.keys() & theirs.keys():
                for i, x in mine[key]:
                    for j, y in theirs[key]:
                        at, pairs = runs.setdefault(j - i, (set(), set()))
                        at.add(i)
                        pairs.update(zip(x, y))
            best = {}
            for at, pairs in runs.values():
                if len(pairs) == len({x for x, _ in pairs}) == len({y for _, y in pairs}):
                    for i in at:
                        best[i] = best.get(i, False) or all(x == y for x, y in pairs)
            if best and len(best) >= share * (n - size + 1) - 1e-9 and (size == words or all(best.values())):
                out.setdefault(d, {})[k] = "exact" if all(best.values()) else "reparameterised"
    return out


def test_leaks_against_brute_force(spark):
    r = random.Random(3)
    word = lambda: r.choice("the of a river walks home counts École Łódź Москва Anna Bob 5 7 12 1,000 kg km hours and then buys".split())
    items = [(i, " ".join(word() for _ in range(r.choice([1, 2, 3, 5, 8, 30])))) for i in range(40)] + [(90, "1 2 3 4 5 6 7 8"), (91, None)]

    def changed(text):
        new = {}
        return " ".join(new.setdefault(w, r.choice(["9", "33", w])) if w[0].isdigit() else new.setdefault(w, r.choice(["Clara", "Дарья", w])) if w[0].isupper() else w if r.random() > 0.02 else word() for w in text.split())

    docs = []
    for i in range(300):
        parts = [" ".join(word() for _ in range(r.randrange(0, 12)))] + [changed(r.choice(items[:-1])[1]) for _ in range(r.randrange(0, 3))] + [" ".join(word() for _ in range(r.randrange(0, 12)))]
        docs.append((i, r.choice([" ", ". ", "; "]).join(parts)))
    docs += [(1000, " ".join(str(x) for x in range(3000))), (1001, None), (1002, "")]
    found = decontam.decontaminate(spark.createDataFrame(docs * 2, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    want = brute_leaks(docs, items)
    assert len(found) == 2 * len(docs) and sum(len(x) for x in want.values()) > 100
    kinds = {x for v in want.values() for x in v.values()}
    assert kinds == {"exact", "reparameterised"}
    for row in found:
        mine = want.get(row["doc_id"], {})
        assert (list(row["items"]), row["kind"]) == (sorted(mine), min(mine.values(), default=None)), row["doc_id"]


def test_leaks_in_rows_that_share_a_doc_id_or_have_none(spark):
    bench = spark.createDataFrame([(1, "seven quick foxes jumped over the very lazy dog today")], "item_id bigint, text string")
    leak, clean = "see: seven quick foxes jumped over the very lazy dog today", "nothing to see here at all"
    table = spark.createDataFrame([(None, leak), (None, clean), (None, None), (1, leak), (1, clean), (2, clean)], "doc_id bigint, text string")
    got = sorted((r["doc_id"] or 0, r["contaminated"]) for r in decontam.decontaminate(table, bench).collect())
    assert got == [(0, False), (0, False), (0, True), (1, False), (1, True), (2, False)]
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in decontam.drop_contaminated(table, bench).collect()) == [(0, ""), (0, clean), (1, clean), (2, clean)]


def test_planted_passages_are_found(spark):
    d, b = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in d.collect()}
    norm = lambda x: re.findall(r"\w+", x.lower())
    items = [" ".join(norm(r["text"])) for r in b.collect()]
    want = {i for i, x in texts.items() if any(f" {q} " in f" {' '.join(norm(x))} " for q in items)}
    got = {r["doc_id"] for r in decontam.decontaminate(d, b).where("contaminated").collect()}
    assert want and got == want


def brute_repeats(rows, length=100):
    seen, out = set(), {}
    for d, x in sorted(rows):
        raw = (x or "").encode()
        gone = np.zeros(len(raw) + 1, int)
        for p in range(len(raw) - length + 1):
            if (k := raw[p : p + length]) in seen:
                gone[p] += 1
                gone[p + length] -= 1
            seen.add(k)
        gone = np.cumsum(gone)[: len(raw)] > 0
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out[d] = (len(raw), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def all_hot(monkeypatch):
    for name, value in (("SAMPLE", 1), ("LEAST_HOT", 1), ("MOST_HOT", 1 << 40)):
        monkeypatch.setattr(suffix_dedup, name, value)


@pytest.mark.parametrize("hot", [False, True])
def test_repeated_bytes(spark, docs, rows, empty, monkeypatch, hot):
    if hot:
        all_hot(monkeypatch)
    passage = "".join(R.choice("abc ") for _ in range(180))
    more = [(50_000 + i, "".join(R.choice("xyz é") for _ in range(R.randrange(0, 60))) + passage[R.randrange(0, 30) :] + "q" * R.randrange(0, 150)) for i in range(40)]
    more += [(60_000, "ab" * 500), (60_001, "ab" * 300), (60_002, "e" * 99), (60_003, "e" * 100), (60_004, "e" * 101)]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id bigint, text string"))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.removed_digests(table).collect()}
    assert got == brute_repeats([*rows, *more])
    assert suffix_dedup.removed_digests(empty).count() == 0


@pytest.mark.parametrize("length, gram", [(100, 32), (60, 16), (80, 32), (200, 64)])
def test_rounds_at_other_offsets(spark, length, gram):
    r = random.Random(length)
    passage = "".join(r.choice("ab cd") for _ in range(3 * length))
    table = [(i, "".join(r.choice("xyz") for _ in range(r.randrange(0, 40))) + passage[(a := r.randrange(0, 2 * length)) : a + r.randrange(length // 2, 2 * length)] + "q" * r.randrange(0, 30)) for i in range(80)]
    table.append((2**63 - 1, passage))
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in suffix_dedup.removed_digests(spark.createDataFrame(table, "doc_id bigint, text string"), length, gram).collect()}
    assert got == brute_repeats(table, length)


def test_one_gram_in_many_places(spark):
    """A gram with hundreds of different surroundings, some of them repeated."""
    r = random.Random(2)
    some = lambda n: "".join(r.choice("abcdefghijklmnop ") for _ in range(n))
    gram, sides = some(40), [(some(90), some(90)) for _ in range(60)]
    table = [(i, r.choice(sides)[0][r.randrange(0, 40) :] + gram + r.choice(sides)[1][: r.randrange(40, 90)]) for i in range(400)]
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in suffix_dedup.removed_digests(spark.createDataFrame(table, "doc_id bigint, text string").repartition(6)).collect()}
    assert got == brute_repeats(table)


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("parts", [1, 6])
def test_repeated_bytes_of_repeated_and_null_ids(spark, monkeypatch, hot, parts):
    if hot:
        all_hot(monkeypatch)
    r = random.Random(5)
    some = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage = some(300)
    twice, one, other = some(150) + passage, some(120) + passage[40:], passage[:250] + some(130)
    table = [(1, twice), (1, twice), (1, twice), (2, one), (2, one), (2, other), (3, some(400))]
    table += [(None, some(90) + passage[i:] + some(150)) for i in (0, 10, 20)] + [(None, some(500)), (None, None), (None, twice), (None, twice)]
    df = spark.createDataFrame(table, "doc_id bigint, text string").repartition(parts)
    digest = {x["text"]: x["h"] for x in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(set(table), key=lambda x: (x[0] is None, x[0] or 0, digest[x[1]]))
    want = brute_repeats([(i, x) for i, (_, x) in enumerate(order)])
    got = sorted(((x["doc_id"] or -1, x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in suffix_dedup.removed_digests(df).collect()))
    assert got == sorted((d or -1, *want[order.index((d, x))]) for d, x in table)


def test_exact_groups(spark, docs, rows, empty, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT", 20)
    groups = {}
    for d, x in rows:
        groups.setdefault(re.sub(SPACE, "", x or ""), []).append((-len(x or ""), d))
    want = {}
    for k, g in groups.items():
        keep = min(g)[1]
        for _, d in g:
            want[d] = (keep, len(g), d == keep, hashlib.sha256(k.encode()).hexdigest())
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.exact_groups(docs).collect()}
    assert got == want
    assert exact_dedup.exact_groups(empty).count() == 0
    twice = spark.createDataFrame([(1, "a b", 1), (1, "a b", 2), (2, "ab", 3), (None, "ab", 4), (None, None, 5), (3, "", 6)], "doc_id bigint, text string, _nth int")
    out = exact_dedup.exact_groups(twice)
    assert out.count() == 6 and out.where("kept").count() == 2
    kept = exact_dedup.keep_one(twice)
    assert kept.columns == twice.columns and sorted(kept.toPandas()["doc_id"]) == [1, 3]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 40, 41, 1000])
def test_permutation_is_one_to_one(spark, n):
    assert sorted(sharding.permuted_py(i, n, 5) for i in range(n)) == list(range(n))
    got = [r["p"] for r in spark.range(n).select(sharding.permuted(F.col("id"), n, 5).alias("p"), "id").orderBy("id").collect()]
    assert got == [sharding.permuted_py(i, n, 5) for i in range(n)]


def test_shards(spark, docs, rows, empty):
    got = sharding.shard(docs).collect()
    order = sorted(rows, key=lambda r: (r[0], len((r[1] or "").encode()) + 16))
    key = 20260101
    want = {d: sharding.permuted_py(i, len(rows), key) for i, (d, _) in enumerate(order)}
    for r in got:
        assert (r["shard"], r["slot"]) == (want[r["doc_id"]] % 40, want[r["doc_id"]] // 40)
    text = dict(rows)
    assert all(r["size"] == len((text[r["doc_id"]] or "").encode()) + 16 and r["text_crc32"] == zlib.crc32((text[r["doc_id"]] or "").encode()) for r in got)
    counts = Counter(r["shard"] for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n)) for s, n in counts.items())
    assert sharding.shard(empty).count() == 0
    same = spark.createDataFrame([(1, "a")] * 50 + [(None, None)] * 50, "doc_id bigint, text string")
    assert len({(r["shard"], r["slot"]) for r in sharding.shard(same).collect()}) == 100


def test_blocks_cover_all_rows():
    import pyarrow as pa

    texts = ["a" * n for n in (0, 5, 3, 100, 0, 7)] + [None]
    got = [bytes(raw[x:y]).decode() for _, _, raw, b in shared.text_blocks(pa.array(texts), 10) for x, y in zip(b[:-1], b[1:])]
    assert got == [t or "" for t in texts]


def test_least_and_greatest_ids_in_a_hot_group(spark):
    """More rows than a thousandth are one text; the winner is the least id there is, and null comes last."""
    ids = [2**63 - 1, -(2**63), 0, None, *range(100, 150)]
    rows = [(d, "one text") for d in ids] + [(d, "one  text") for d in (-(2**63), 7)] + [(None, "other")] * 30
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {(r["keep_id"], r["group_size"]) for r in got if r["text_sha256"] == hashlib.sha256(b"onetext").hexdigest()} == {(-(2**63), 56)}
    assert [(r["doc_id"], r["keep_id"]) for r in got if r["kept"]] in ([(-(2**63), -(2**63)), (None, None)], [(None, None), (-(2**63), -(2**63))])
    assert exact_dedup.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).count() == 2
