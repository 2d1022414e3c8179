"""Section chunks against a plain reading of their rules, line by line."""

import re

from pyspark.sql import functions as F

from docforge.operators import chunking

TOKEN = re.compile(r"\w+|[^\w\s]")
SENTENCE = "The supplier delivers all goods in time and in good order to the buyer of them. "


def plain(text, kind):
    """The rules over Python lines: openings, sections, groups, windows."""
    at, rows = 0, []
    for line in re.findall("[^\n]*\n|[^\n]+", text):
        rows.append((at, line))
        at += len(line)
    bare = [x.strip() for _, x in rows]
    opens = []
    for i, (_, line) in enumerate(rows):
        s, n = bare[i], len(TOKEN.findall(bare[i]))
        if kind == "risk_factors":
            nxt = next((b for b in bare[i + 1 :] if b), "")
            opens.append(bool(s) and ((s.isupper() and 2 <= n <= 15) or (s[0].isupper() and 6 <= n <= 80 and len(nxt) > len(s))))
        else:
            opens.append(bool(re.search(chunking.CONTRACT.replace(r"\z", r"\Z"), line)))
    count = sum(opens) if kind == "risk_factors" else sum(o for i, o in enumerate(opens) if i) + 1
    if count < 3:
        opens = [i > 0 and not bare[i - 1] and bool(bare[i]) for i in range(len(rows))]
    parts = []
    for i, (start, line) in enumerate(rows):
        if not bare[i]:
            continue
        if opens[i] or not parts:
            parts.append([])
        parts[-1].append((start + len(line) - len(line.lstrip()), start + len(line.rstrip()), len(TOKEN.findall(line))))
    groups, held = [], []
    for p in parts:
        held += p
        if sum(x[2] for x in held) >= 80:
            groups.append(held)
            held = []
    if held and groups:
        groups[-1] = groups[-1] + held
    elif held:
        groups.append(held)
    out = []
    for g in groups:
        lo, hi, n = g[0][0], g[-1][1], sum(x[2] for x in g)
        if n <= 400:
            out.append((lo, hi))
            continue
        toks = [m.span() for m in TOKEN.finditer(text[lo:hi])]
        i = 0
        while True:
            win = toks[i : i + 400]
            out.append((lo + win[0][0], lo + win[-1][1]))
            if i + 400 >= len(toks):
                break
            i += 320
    return sorted(out)


def test_sections_follow_their_rules(spark):
    contract = "".join(f"{i}. Heading of part\n" + SENTENCE * (3 if i % 3 else 9) + "\n\n" for i in range(1, 12))
    risk = "RISKS OF OUR BUSINESS\n" + "".join(f"We may lose customer number {i} soon.\n{SENTENCE * (2 + i % 8)}\n" for i in range(9))
    texts = [("contract", contract), ("risk_factors", risk), ("contract", (SENTENCE * 4 + "\n\n") * 6), ("contract", SENTENCE * 150), ("risk_factors", "short text"), ("contract", "  \n \n"), ("contract", "ARTICLE IV\n" + SENTENCE * 9 + "\nSection 2.1 Terms\n" + SENTENCE * 60 + "\nGENERAL TERMS:\nlast"), ("contract", ""), ("contract", None)]
    df = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(texts)], "doc_id int, doc_type string, text string")
    got = chunking.sections(df).collect()
    assert all(r["tokens"] <= 400 for r in got)
    for i, (kind, text) in enumerate(texts):
        assert sorted((r["start"], r["end"]) for r in got if r["doc_id"] == i) == plain(text or "", kind), i
    kinds = {r["doc_id"]: r["boundary"] for r in got}
    assert (kinds[0], kinds[1], kinds[2], kinds[4]) == ("contract_heading", "risk_heading", "paragraph", "paragraph")
    ids = sorted(r["chunk_id"] for r in chunking.chunk_rows(df.where("doc_id = 0"), "section").collect())
    assert ids == [f"0:section:{i:04d}" for i in range(len(ids))]


def test_sections_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.lit("risk_factors").alias("doc_type"), "text")
    got: dict[int, list] = {}
    for r in chunking.sections(docs).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["end"]))
    for r in docs.collect():
        assert sorted(got.get(r["doc_id"], [])) == plain(r["text"], "risk_factors"), r["doc_id"]


def test_playbooks_keep_their_categories(spark):
    df = spark.createDataFrame([(1, "playbook", "# P\nintro\n## 1. One\n" + SENTENCE * 60 + "\n## 2. Two\nx\n")], "doc_id int, doc_type string, text string")
    got = chunking.chunk_rows(df, "section").orderBy("start").collect()
    assert [r["text"].split("\n")[0] for r in got] == ["# P", "## 1. One", "## 2. Two"] and {r["boundary"] for r in got} == {"playbook_heading"}


def test_lines_are_made_once_for_short_and_long_sections(spark):
    long = "1. Alpha beta\n" + "word " * 500 + "\n2. Gamma delta\n" + "term " * 100 + "\n3. Epsilon\n" + "name " * 90
    df = spark.createDataFrame([(1, "contract", long), (2, "contract", "short"), (3, "contract", None), (None, "contract", "no key")], "doc_id long, doc_type string, text string")
    made = chunking.sections(df)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate posexplode") == 1 and "Union" not in plan
    got = {i: sorted((r["start"], r["end"], r["tokens"]) for r in made.collect() if r["doc_id"] == i) for i in (1, 2, 3, None)}
    assert [t for *_, t in got[1]] == [400, 184, 104, 93] and got[2] == [(0, 5, 1)] and not got[3] and got[None] == [(0, 6, 2)]
