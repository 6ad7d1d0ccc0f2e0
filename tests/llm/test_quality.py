import re
from collections import Counter

from textloom.llm import quality

WORD = r"[^\x20\x09-\x0D]+"


def measured(text):
    words = re.findall(WORD, text or "")
    lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), sum(n - 1 for n in Counter(lines).values()), len(repeated), failed


def verdicts(rows, rules):
    """Common lines by comparing every line with every document of its host."""
    hosts, having = {}, Counter()
    for text, host in {(r[1] or "", r[2]) for r in rows}:
        hosts[host] = hosts.get(host, 0) + 1
        for line in {quality.normalised_line(x) for x in text.split("\n") if re.search(WORD, x)}:
            having[host, line] += 1
    return sorted((verdict(r, having, hosts, rules) for r in rows), key=repr)


def cleaned(rows, rules):
    """(doc_id, text) of what is kept, without common lines."""
    hosts, having = {}, Counter()
    for text, host in {(r[1] or "", r[2]) for r in rows}:
        hosts[host] = hosts.get(host, 0) + 1
        having.update((host, line) for line in {quality.normalised_line(x) for x in text.split("\n") if re.search(WORD, x)})
    common = {(h, line) for (h, line), n in having.items() if n > rules.min_line_documents and n > rules.max_line_share * hosts[h]}
    stays = lambda x, host: not re.search(WORD, x) or (host, quality.normalised_line(x)) not in common
    kept = [v[-2] for v in map(lambda r: verdict(r, having, hosts, rules), rows)]
    return sorted(((i, "\n".join(x for x in t.split("\n") if stays(x, host))) for (i, t, host), k in zip(rows, kept) if k), key=repr)


def verdict(row, having, hosts, rules):
    doc_id, text, host = row
    base = measured(text)
    gone = 0
    for x in (text or "").split("\n"):
        n = having[host, quality.normalised_line(x)]
        if re.search(WORD, x) and n > rules.min_line_documents and n > rules.max_line_share * hosts[host]:
            gone += len(re.findall(WORD, x))
    left = base[0] - gone
    depleted = gone > 0 and (left < rules.min_kept_words or left < rules.min_kept_share * base[0])
    return (doc_id, *base, not base[-1] and not depleted, gone)


def test_counts_of_plain_rules(make, corpus, rows_of):
    rules = quality.Rules()
    assert rows_of(quality.judged(make(corpus), rules)) == verdicts(corpus, rules)


def boilerplate():
    """A host whose documents share a footer, one without, and copies that must not make a line common."""
    body = lambda i: " ".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}{k}" for k in range(12))
    rows = [(i, f"{body(i)}\nAll rights reserved {i % 10} here\nsubscribe now to get our news and more of it every day", "a") for i in range(8)]
    rows += [(20 + i, "All  rights reserved 7 here\nSubscribe now to get our news and more of it every day\nshort rest", "a") for i in range(2)]
    rows += [(40 + i, f"{body(40)}\n{body(41)}", "b") for i in range(9)] + [(60, f"{body(40)}\n{body(60)}", "b"), (61, f"{body(61)}\nz", None)]
    return rows


def test_common_lines_deplete(make, rows_of):
    rules = quality.Rules(min_line_documents=3, max_line_share=0.2)
    rows = boilerplate()
    found = rows_of(quality.judged(make(rows), rules))
    assert found == verdicts(rows, rules)
    assert {r[0] for r in found if not r[7]} == {20, 21}
    kept = quality.kept_documents(make(rows), rules)
    assert kept.columns == make(rows).columns
    assert {r[0] for r in rows_of(kept, "doc_id")} == {r[0] for r in rows} - {20, 21}


def test_kept_documents_keep_repeated_rows(make, corpus, rows_of):
    kept = rows_of(quality.kept_documents(make(corpus)), "doc_id", "text")
    judged = verdicts([r if len(r) > 2 else (*r, "s1") for r in corpus], quality.Rules())
    assert Counter(r[0] for r in kept) == Counter(r[0] for r in judged if r[-2])


def test_empty_table(make, rows_of):
    assert rows_of(quality.judged(make([]))) == [] and rows_of(quality.kept_documents(make([]))) == []


def test_common_lines_are_removed(make, rows_of):
    rules = quality.Rules(min_line_documents=3, max_line_share=0.2)
    rows = boilerplate()
    left = quality.without_common_lines(make(rows), rules)
    assert left.columns == make(rows).columns and left.schema.simpleString() == make(rows).schema.simpleString()
    want = sorted(((i, t.split("\n")[0] if h == "a" else t) for i, t, h in rows if i not in (20, 21)), key=repr)
    assert rows_of(left, "doc_id", "text") == want
    assert all(r.n_chars == len(r.text) for r in left.collect())
    assert rows_of(quality.without_common_lines(make([]), rules)) == []


def test_stage_removes_common_lines_under_its_own_limits(spark, make, rows_of):
    """A footer in 120 distinct documents of a host, or in the four of a small one, is above the limits of the production rules."""
    import corpus_pipeline

    letters = lambda i: "".join(chr(97 + int(d)) for d in str(i))  # noqa: E731  # digits are all alike in a line
    body = lambda i: " ".join(f"w{letters(i)}x{letters(k)}" for k in range(12))
    footed = lambda i, host: (i, f"{body(i)}\nAll rights reserved by us", host)
    rows = [footed(i, "a") for i in range(120)] + [footed(200 + i, "c") for i in range(4)] + [footed(500, "b")]
    left = rows_of(corpus_pipeline.quality_rules(spark, make(rows), ""), "doc_id", "text", "n_chars")
    assert left == sorted([(r[0], body(r[0]), len(body(r[0]))) for r in rows[:-1]] + [(500, rows[-1][1], len(rows[-1][1]))], key=repr)


def test_production_rules_act_on_the_tables(spark):
    """Lines are removed and documents rejected for them, on the tables at hand."""
    from textloom.llm import queries

    found = queries.op10_quality_rules(spark, "/root/testdata/sf0.1").selectExpr("count_if(n_common_words > 0) AS cut", "count_if(NOT kept AND NOT base_failed) AS rejected").first()
    assert found.cut > 0 and found.rejected > 0


def test_stage_keeps_odd_rows(spark, make, corpus, rows_of):
    import corpus_pipeline

    want = cleaned([r if len(r) > 2 else (*r, "s1") for r in corpus], quality.Rules())
    assert rows_of(corpus_pipeline.quality_rules(spark, make(corpus), ""), "doc_id", "text") == want
