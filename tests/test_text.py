import pytest
from kelpworks.functions import planning
from kelpworks.functions import text as t
from kelpworks.operators import intents, listing
from pyspark.sql import functions as F


def one(spark, value, of):
    return spark.createDataFrame([(value,)], "x string").select(of(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(
    ("of", "value", "wanted"),
    [
        (t.normalize_text, "  Đường  Cầu-Giấy, số 5 ", "duong cau giay so 5"),
        (t.normalize_text, None, ""),
        (t.normalize_text, "é", "e"),
        (t.normalize_planning, "31/12/2024 – Đất ở.", "31/12/2024 dat o."),
        (t.normalize_loose, "Giá: 5,2 Tỷ!", "gia: 5,2 ty!"),
        (t.normalize_metadata, "HN-Ba Đình", "hn-ba dinh"),
        (t.compact, "Ba Đình, HN", "badinhhn"),
        (t.clean_text, " a\t b\n\n\n\nc \u0000", "a b\n\nc"),
        (t.sanitize, "ﬁn\u0007e  x", "fine x"),
        (t.repair_mojibake, "Hà Nội".encode().decode("latin1"), "Hà Nội"),
        (t.repair_mojibake, "plain", "plain"),
        (t.slug, "BGE-M3 / v2", "bge_m3_v2"),
        (lambda c: t.hierarchy_level(c), "Phần II Đất", 1),
        (lambda c: t.hierarchy_level(c), "2.1 Rừng", 3),
        (lambda c: t.hierarchy_level(c), "3. Ao", 4),
        (lambda c: t.hierarchy_level(c), "b) Hồ", 5),
        (lambda c: t.hierarchy_level(c), "hồ", None),
        (t.is_heading, "DANH MỤC CÔNG TRÌNH", True),
        (t.is_weak_chunk, "12", True),
        (t.is_weak_chunk, "Đất ở 12 ha", False),
        (t.positive_int, "-3", None),
        (t.positive_int, " 7 ", 7),
        (t.positive_int, "x", None),
        (t.year_in, "năm 2025", 2025),
        (t.list_of, "{a, ,b}", ["a", "b"]),
        (lambda c: t.format_price(c.cast("double")), "5200000000", "5.2 tỷ"),
        (lambda c: t.format_vnd(c), "5200000", "5.200.000 VND"),
        (lambda c: t.format_distance(c.cast("double")), "1500", "1.5 km"),
        (listing.price_vnd, "giá 5,2 tỷ", 5.2e9),
        (listing.area_m2, "60,5 m²", 60.5),
        (listing.direction, "hướng Đông Nam nhé", "dong nam"),
        (intents.district_of, "đất ở quận Cầu Giấy", "Cầu Giấy"),
        (intents.district_of, "HN-BaDinh-KH2025", "Ba Đình"),
        (intents.district_of, "đâu đó", None),
        (intents.planning_intent, "quy hoạch thửa đất", True),
        (intents.planning_intent, "thu hồi", False),
        (intents.mentioned_post, "tin số 42", 42),
        (intents.language_of, "nhà giá bao nhiêu", "vi"),
        (intents.language_of, "how much is it", "en"),
        (t.is_heading, "Phụ lục", True),
        (t.is_heading, "Mục", True),
        (t.is_heading, "2025 tổng hợp", True),
        (t.is_heading, "12a tổng hợp", False),
        (t.is_heading, "Đất ở đô thị", False),
        (t.is_project_line, "Trường học 1,2 ha", True),
        (t.is_project_line, "Đất ở đô thị", False),
        (t.is_project_header, "TT Danh mục", True),
        (t.is_project_header, "Danh mục công trình", False),
        (t.is_project_header, "Dự án, công trình, ghi chú", True),
        (lambda c: t.quality_of(c, F.lit(1), F.lit(0)), "a b c d", 0.303),  # 0.35 * 7 / 900 + 0.3, all that is no space is a letter
        (lambda c: t.quality_of(c, F.lit(4), F.lit(2)), "", 0.125),
        (lambda c: t.quality_of(c, F.lit(0), F.lit(0)), None, 0.0),
        (intents.planning_intent, "dự án ở phường Hàng Bài", False),
        (intents.planning_intent, "dự án ở phường Hàng Bài năm 2025", True),
        (intents.planning_intent, "thu hồi ở quận", False),
        (intents.planning_intent, "thu hồi ở thị trấn", True),
        (intents.planning_intent, None, False),
        (intents.district_of, "thửa đất ở Yên Sở", "Hoàng Mai"),
        (intents.language_of, "", "en"),
        (intents.language_of, "tim nha", "vi"),
        (lambda c: intents.postprocessed(F.lit("How is it?"), c), "=== BẤT ĐỘNG SẢN 12 ===\nLISTING_ID: 12\nYes. If you need more information, ask.", "[Xem chi tiết](/posts/12) LISTING_ID: 12\nYes."),
        (lambda c: intents.postprocessed(F.lit("How is it?"), c), "Yes\n  LISTING_ID: 12\n--- Part ---\nNo", "Yes\n\nNo"),
        (lambda c: intents.postprocessed(F.lit("How is it?"), c), "Good quality\nLiên hệ 0901234567", "Good quality"),
        (lambda c: intents.postprocessed(F.lit("Hotline?"), c), "Good\nLiên hệ 0901234567", "Good\nLiên hệ 0901234567"),
        (lambda c: intents.postprocessed(F.lit("Có phù hợp không?"), c), "Giá bán 5 tỷ\nDiện tích 60 m2, giá 5 tỷ\nThe city", "Diện tích 60 m2\nThe city"),
        (lambda c: intents.postprocessed(F.lit("Gần trường học?"), c), "Trường tiểu học\nSiêu thị\nĐẹp", "Trường tiểu học\nĐẹp"),
        (lambda c: intents.postprocessed(F.lit("Có rộng rãi không?"), c), "Rộng 60 m2\nXung quanh đẹp", "Rộng 60 m2"),
        (lambda c: intents.postprocessed(F.lit("x"), c), "Liên hệ", "Liên hệ"),
        (lambda c: intents.postprocessed(F.lit("x"), c), None, None),
    ],
)
def test_text_function(spark, of, value, wanted):
    assert one(spark, value, of) == wanted


@pytest.mark.parametrize(
    ("question", "wanted"),
    [
        ("Dự án chuyển tiếp sang năm 2025 theo kế hoạch?", {"project_structure", "carry_forward"}),
        ("Vì sao dự án chưa thực hiện trong kế hoạch?", {"fact", "project_structure", "project_delay_reason"}),
        ("Kế hoạch nêu lý do gì?", {"fact", "explanatory"}),
        ("Vì sao kế hoạch nhấn mạnh phường Hàng Bài?", {"fact", "focus_area_reason"}),
        ("Vì sao kế hoạch cần tăng đất giao thông?", {"fact", "sector_land_demand", "drainage_transport"}),
        ("Kế hoạch phân tích hiện trạng ra sao?", {"fact"}),
        ("Vì sao trời mưa?", set()),
        (None, set()),
    ],
)
def test_profile_of_a_question(spark, question, wanted):
    got = one(spark, question, intents.query_profile)
    assert {k for k, flag in got.asDict().items() if flag} == wanted


def test_floor_filters_are_put_in_order(spark):
    rows = spark.createDataFrame([("tầng 9 đến 5",), ("khoảng tầng 3",), ("tầng 7",)], "q string").select("q", intents.floor_filter(F.col("q")).alias("f")).select("q", "f.*").collect()
    assert [(r.floor_min, r.floor_max, r.floor) for r in rows] == [(5, 9, None), (2, 4, None), (None, None, 7)]
    df = spark.createDataFrame([("12 Hàng Bài", 30, 9.0, 1.0, 5, 2, 8)], "district string, bedrooms int, price_min double, price_max double, floor int, floor_min int, floor_max int")
    r = intents.sane_filters(df).first()
    assert (r.district, r.bedrooms, r.price_min, r.price_max, r.floor) == (None, None, 1.0, 9.0, None)


@pytest.mark.parametrize(
    ("of", "value", "wanted"),
    [
        (planning.without_metadata, "[chunk=1]\nDistrict: a | title: b | city: c\nĐất ở\nHồ\n[x=y]", "Đất ở\nHồ\n[x=y]"),
        (planning.without_metadata, "[chunk=1]", "[chunk=1]"),
        (planning.is_toc_like, "Mục lục\nPhần 1 .... 3\nPhần 2 .... 9", True),
        (planning.is_toc_like, "Bảng 1 dự án xây dựng, bảng 2", False),
        (planning.is_toc_like, None, False),
        (planning.is_incomplete, "Danh mục công trình", True),
        (planning.is_incomplete, "Thu hồi 12,5 ha đất tại phường Hàng Bài.", False),
        (planning.is_incomplete, "Các loại đất gồm", True),
        (lambda c: planning.unit_headers(t.normalize_text(c)), "phường Hàng Bài, phương án, xã hội, xã Tân Lập", 2),
        (lambda c: planning.haystack(c, F.lit("Ba Đình")), "[a=b]\nĐất", "ba dinh dat"),
    ],
)
def test_planning_function(spark, of, value, wanted):
    assert one(spark, value, of) == wanted


def test_texts_are_taken_from_a_batch_by_slices(monkeypatch):
    import pyarrow as pa
    from kelpworks.functions.text import by_slices
    from kelpworks.operators import chunking

    monkeypatch.setattr(chunking, "SLICE", 5)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array(["abc", None, "defg", "h"])], ["doc_id", "text"])
    assert list(chunking.text_slices(batch)) == [[(1, "abc"), (2, None), (3, "defg")], [(4, "h")]]
    texts = pa.array(["a", None] * 100)
    assert by_slices(texts, str.upper).to_pylist() == ["A", None] * 100
    assert by_slices(texts.slice(0, 0), str.upper).to_pylist() == []


def test_folding_goes_over_letters_without_marks_once(monkeypatch):
    from types import SimpleNamespace
    import unicodedata
    from kelpworks.operators import search

    asked = []
    looked = lambda c: asked.append(c) or unicodedata.category(c)
    monkeypatch.setattr(search, "unicodedata", SimpleNamespace(normalize=unicodedata.normalize, category=looked))
    assert search.folded(" Đường Nguyễn\x1c\tVăn  ỪB 中Ⅷ́ ") == "duong nguyen van ub 中ⅷ" and search.folded("Plain  A") == "plain a" and search.folded(None) == ""
    assert not [c for c in asked if c.isascii()]
