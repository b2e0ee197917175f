from kelpworks.operators import cases, chunking, evaluation, filters, listing, search
from kelpworks.operators.context import compacted, filled, keep_or_all, names_one_listing
from kelpworks.plans.evaluation import matrix
from pyspark.sql import functions as F


def test_winner_of_the_published_matrix(spark):
    rows = evaluation.eligible(matrix(spark), 0.97892, 0.803262).collect()
    best = evaluation.winner(rows)
    assert (best.model, best.chunking, best.top_k, best.cost) == ("bge-m3", "parent_context", 8, 7.64533)
    assert evaluation.winner([]) is None


def test_filter_trees():
    assert filters.build_filter({}) == {}
    assert filters.build_filter({"city": "x"}) == {"city": {"$eq": "x"}}
    tree = filters.build_filter({"city": "x", "priceMin": 1, "priceMax": 2})
    assert tree == {"$and": [{"city": {"$eq": "x"}}, {"price": {"$gte": 1}}, {"price": {"$lte": 2}}]}
    assert filters.conjunction(tree, {}, {"postId": 3})["$and"][-1] == {"postId": 3} and filters.names_one(filters.conjunction(tree, {"postId": 3})) and not filters.names_one(tree)
    assert filters.merged({"price": {"$gte": 1}}, {"price": {"$lte": 2}, "chunkTypes": ["a"]}) == {"price": {"$gte": 1, "$lte": 2}, "chunkType": {"$in": ["a"]}}


def test_compiled_filter_compares_numbers_and_folded_case(spark):
    df = spark.createDataFrame([("10", " X"), ("9", "x"), ("", "y"), (None, None)], "price string, city string")
    assert [r.price for r in df.where(filters.compiled({"price": {"$gte": 9.5}})).collect()] == ["10"]
    assert df.where(filters.compiled({"$or": [{"city": "X"}, {"price": {"$in": [10]}}]})).count() == 2
    assert df.where(filters.compiled({})).count() == 4


def test_terms_and_weights():
    terms = search.terms_of("Kế hoạch sử dụng đất quận Ba Đình năm 2025 HN/12")
    assert "2025" in terms and any(" " in t for t in terms) and "va" not in terms
    assert [search.weight_of(t) for t in ("ke hoach su dung", "20251", "a/b", "abcdefghi", "abc")] == [2.4, 2.0, 1.8, 1.4, 1.0]


def test_lexical_gate_and_scope():
    assert search.wants_lexical(3, 8, True, False) and not search.wants_lexical(8, 8, True, False) and not search.wants_lexical(0, 8, True, False) and search.wants_lexical(0, 8, False, False) and not search.wants_lexical(3, 8, True, True)
    scope = search.Scope(50, fact=True)
    assert (scope.final_k, scope.probe_k, scope.min_docs(), scope.min_docs(True)) == (16, 120, 8, 8)
    assert [search.table_quota(n, t) for n, t in ((1, False), (8, False), (8, True), (3, False))] == [1, 4, 2, 1]
    assert search.query_candidates("q", "d", 2025, "x") == ["q", "q d", "q 2025", "q d 2025", "x"]


def test_cascade_takes_the_first_step_with_enough_or_the_fullest(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 0)], "k string, n int")
    out = search.cascade(df, "k", [(F.col("n") < 2, 3), (F.col("n") < 4, 3)])
    assert {(r.k, r.n, r.step) for r in out.collect()} == {("a", i, 1) for i in range(4)} | {("b", 0, 0)}


def test_greedy_fill_skips_or_stops(spark):
    df = spark.createDataFrame([(["aa", "b" * 50, "cc"],)], "l array<string>")
    r = df.select(filled(F.col("l"), 5, 10).alias("skip"), filled(F.col("l"), 5, 10, skip=False).alias("stop")).first()
    assert (r["skip"], r["stop"]) == ("aa\ncc", "aa")
    again = spark.createDataFrame([("Một\nmột \nhai",)], "t string").select(compacted(F.col("t"))).first()[0]
    assert again == "Một\nhai"


def test_batches_are_numbered_on_in_parts(spark):
    batches = [spark.createDataFrame([(i,) for i in ids], "case_id long") for ids in ([5, 3, 9, 9, None], [], [2, 1, 4])]
    for parts in (1, 3, 50):
        rows = cases.merged_results(batches, "case_id", parts).collect()
        assert [(r.batch, r.case_id) for r in sorted(rows, key=lambda r: r.position)] == [(0, None), (0, 3), (0, 5), (0, 9), (0, 9), (2, 1), (2, 2), (2, 4)]
        assert sorted(r.position for r in rows) == list(range(8))
    assert cases.merged_results([batches[1]], "case_id").count() == 0


def test_best_matches_in_blocks_agree_with_one_block(spark):
    rows = spark.createDataFrame([(i, f"l{i % 7}", [float(i % 13 + 1), float(i % 5), 1.0]) for i in range(801)] + [(900, "x", None)], "vec_id long, label string, embedding array<double>")
    whole = {tuple(r) for r in search.best_matches(rows, F.col("vec_id") % 100 == 0, block=50).collect()}
    assert whole == {tuple(r) for r in search.best_matches(rows, F.col("vec_id") % 100 == 0, block=2).collect()} and {r[0] for r in whole} == set(range(0, 801, 100))
    assert search.best_matches(rows.limit(0), F.lit(True)).collect() == []


def test_semi_joins_pass_what_they_should(spark):
    docs = spark.createDataFrame([("1",), ("2",), (None,), ("x",)], "post string")
    ids = spark.createDataFrame([(1,)], "id long")
    assert {r.post for r in listing.semi_by_id(docs, ids, "post").collect()} == {"1", None}
    assert {r.post for r in listing.semi_by_id(docs, ids, "post", unparsed_passes=True).collect()} == {"1", None, "x"}


def test_splitter_keeps_separators_and_overlap():
    pieces = chunking.split_text("\n\n".join(f"{i} " + "word " * 30 for i in range(20)), 400, 60)
    assert all(len(p) <= 400 for p in pieces) and all(any(f"{i} word" in p for p in pieces) for i in range(20))
    assert chunking.split_text("", 10, 2) == [] and max(map(len, chunking.split_text("x" * 95, 10, 2))) <= 10


TEXT = "QUYẾT ĐỊNH PHÊ DUYỆT\nCăn cứ Luật Đất đai;\nCăn cứ Nghị định 43;\nĐiều 1. Phê duyệt kế hoạch với tổng diện tích 12,5 ha tại quận Ba Đình.\nĐiều 2. Tổ chức thực hiện kế hoạch đã duyệt theo đúng quy định.\nNơi nhận: như trên"


def test_archetypes_and_decision_articles():
    assert chunking.archetype(TEXT.split("\n")) == "decision"
    chunks = chunking.document_chunks(TEXT, "structured")
    assert [c["section_heading"] for c in chunks if c["chunk_type"] == "article"] == TEXT.split("\n")[3:5]
    assert [c["global_index"] for c in chunks] == list(range(1, len(chunks) + 1)) and all(c["line_start"] for c in chunks)


TABLE = "A KẾ HOẠCH\nII ĐẤT Ở\na) Các khu\n1. Dự án trường học 1,2 ha\n2. Dự án chợ 0,5 ha\nDự án bến xe 3 ha\nthu hồi tại phường\nii. dự án khác"


def test_table_archetype_and_contextual_chunks():
    lines = TABLE.split("\n")
    assert chunking.archetype(lines) == "hierarchical_table" and chunking.archetype(lines[3:]) == "narrative_report" and chunking.archetype([]) == "narrative_report"
    found = chunking.contextual([lines])
    assert [c["content"].split("\n")[-1] for c in found] == ["thu hồi tại phường", "ii. dự án khác"] and {c["chunk_type"] for c in found} == {"table"}
    assert found[0]["hierarchy_path"] == "A KẾ HOẠCH > II ĐẤT Ở > 2. Dự án chợ 0,5 ha"
    full = chunking.contextual([[f"dòng chữ thứ {i}" for i in range(16)]])
    assert [len(c["content"].split("\n")) for c in full] == [14, 3] and chunking.contextual([]) == []


def test_chunks_are_located_by_the_words_that_lines_hold():
    pages = [["một hai", "ba bốn", "năm sáu"], ["bảy tám", "chín mười"]]
    at = chunking.Locator(pages)
    assert at.find("ba bốn năm sáu", 1) == (1, 1, 3) and at.find("bảy tám", 1) == (2, 1, 1) and at.find("một hai", 1) is None and at.find("", 1) is None
    assert chunking.Locator(pages).find("chín x w", 2) is None and chunking.Locator(pages).find("chín mười x", 2) == (2, 1, 2)


def test_hierarchy_modes():
    text = "Phần I Hiện trạng\n1.1 Đất ở\nDiện tích đất ở đô thị tăng đều qua các năm gần đây.\nPhần II Kế hoạch\nKế hoạch thu hồi 3,2 ha cho công trình giao thông."
    inline = chunking.document_chunks(text)
    assert inline[0]["content"].startswith("[hierarchy_path=Phần I Hiện trạng > 1.1 Đất ở]") and inline[1]["hierarchy_path"] == "Phần II Kế hoạch"
    parents = [c for c in chunking.document_chunks(text, "parent_child") if c["is_parent"]]
    assert len(parents) == 2 and chunking.document_chunks("") == []


def test_metric_rows_and_targets(spark):
    df = spark.sql("select array(named_struct('metrics_data', array(named_struct('name', 'Contextual Relevancy', 'score', 0.5), named_struct('name', 'other', 'score', 1.0)))) as test_results")
    assert [tuple(r) for r in evaluation.metric_rows(df).collect()] == [(0, "contextual_recall", 0.5)]
    got = spark.createDataFrame([("x postId=12; propertyId: 3",)], "t string").select(*evaluation.target_metadata(F.col("t"))).first()
    assert tuple(got) == (12, 3, None)


def test_the_longer_list_wins_only_where_it_is_strictly_longer(spark):
    of = lambda pairs: spark.createDataFrame(pairs, "q int, doc string")
    current, candidate = of([(1, "a"), (1, "b"), (2, "c"), (None, "n")]), of([(1, "x"), (1, "y"), (2, "z"), (2, "w"), (3, "v"), (None, "m"), (None, "o")])
    got = {(r.q, r.doc) for r in search.richer(current, candidate, ["q"]).collect()}
    assert got == {(1, "a"), (1, "b"), (2, "z"), (2, "w"), (3, "v"), (None, "m"), (None, "o")}
    assert {r.doc for r in search.richer(current, candidate.limit(0), ["q"]).collect()} == {"a", "b", "c", "n"}


def test_chunks_are_scanned_by_their_number(spark):
    rows = spark.createDataFrame([("d", None, None), ("b", "2", "9"), ("c", None, "10"), ("a", "10", None)], "doc string, whole string, local string")
    got = [r.doc for r in search.chunk_scan(rows, F.col("whole"), F.col("local")).collect()]
    assert got == ["d", "b", "a", "c"]
    assert search.chunk_scan(rows, F.col("whole"), F.col("local"), 0).count() == 1


def test_quota_and_turns_keep_what_whole_windows_keep(spark):
    rows = spark.createDataFrame([(i % 3 if i % 7 else None, "table" if i % 2 else "text", i) for i in range(60)], "g int, kind string, n int")
    own = {}
    for g, kind, n in sorted(rows.collect(), key=lambda r: r.n):
        own.setdefault(g, []).append((kind, n))
    for limit in (1, 4, 9, 40):
        quota = {"table": search.table_quota(limit, False)}
        quota["text"] = limit - quota["table"]
        want = set()
        for g, items in own.items():
            taken = {k: [n for kind, n in items if kind == k][:q] for k, q in quota.items()}
            early = sorted(taken["table"] + taken["text"])
            order = early + [n for _, n in items if n not in early]
            want |= {(g, n, place) for place, n in enumerate(order[:limit], 1)}
        assert {(r.g, r.n, r.place) for r in search.quota_select(rows, "g", "kind", [F.col("n")], limit).collect()} == want
    got = [(r.g, r.n, r.turn) for r in evaluation.balanced_sample(rows, "g", "n", 7).collect()]
    firsts = sorted(own, key=lambda g: own[g][0][1])
    assert got == [(g, own[g][turn][1], turn + 1) for turn in range(3) for g in firsts][:7]


def test_a_group_without_a_fit_keeps_all(spark):
    rows = spark.createDataFrame([(1, True), (1, False), (2, False), (2, None), (None, True), (None, False)], "g int, ok boolean")
    got = sorted(((r.g, r.ok) for r in keep_or_all(rows, F.col("ok"), "g").collect()), key=str)
    assert got == sorted([(1, True), (2, False), (2, None), (None, True)], key=str)
    assert keep_or_all(rows.limit(0), F.col("ok"), "g").count() == 0


def test_single_listing_answers(spark):
    cases_ = [
        ("Tìm căn hộ", "Hiện tại có một căn phù hợp", True), ("Tìm một căn", "Căn hộ ở Ba Đình", True), ("Tìm nhà", "Xem /posts/12", True), ("Tìm nhà", "Xem /posts/12 và /Posts/13", False),
        ("Tìm một căn", "Danh sách: /posts/12", False), ("Tìm nhà", "Không có", False), ("một căn", "", False), ("một căn", None, False), (None, "một căn", True),
    ]
    df = spark.createDataFrame([(i, q, a) for i, (q, a, _) in enumerate(cases_)], "i int, q string, a string")
    got = [r.one for r in df.select("i", names_one_listing(F.col("q"), F.col("a")).alias("one")).orderBy("i").collect()]
    assert got == [x[2] for x in cases_]


def test_post_types_and_token_usage(spark):
    df = spark.createDataFrame([(0, "RENT"), (1, "Cần bán"), (2, " Đổi nhà "), (3, ""), (4, None), (5, "thuê")], "i int, t string")
    assert [r.n for r in df.select("i", listing.post_type_name(F.col("t")).alias("n")).orderBy("i").collect()] == ["Cho thue", "Can ban", "Đổi nhà", None, None, "Cho thue"]
    messages = [
        ('{"usage_metadata": {"input_tokens": 3, "output_tokens": 4, "total_tokens": 9}}', (3, 4, 9)), ('{"response_metadata": {"token_usage": {"prompt_tokens": 5, "completion_tokens": "6"}}}', (5, 6, 11)),
        ('{"response_metadata": {"token_usage": {}, "usage": {"input_tokens": 1, "output_tokens": 2}}}', (1, 2, 3)), ('{"usage_metadata": {"input_tokens": 0}, "response_metadata": {"usage": {"prompt_tokens": 8}}}', (8, None, None)),
        ('{"usage_metadata": {"input_tokens": "x"}}', (None, None, None)), ("no json", (None, None, None)), (None, (None, None, None)),
    ]
    df = spark.createDataFrame([(i, m) for i, (m, _) in enumerate(messages)], "i int, m string")
    assert [tuple(r.u) for r in df.select("i", evaluation.token_usage(F.col("m")).alias("u")).orderBy("i").collect()] == [x[1] for x in messages]


def test_target_score_takes_accents_as_they_are_written(spark):
    score = lambda text, **more: cases.target_score(F.lit(text), ["Licence"], {"k": ("apache",)}, **more)
    row = spark.range(1).select(score("Épapachê, licènce").alias("folded"), score("Épapachê, licènce", accents=True).alias("written"), score("APACHE licence", accents=True).alias("both")).first()
    assert tuple(round(x, 6) for x in row) == (2.95, 0.0, 2.95)
