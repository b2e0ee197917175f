"""Word lists that must be the same for the same answers. All are folded (no accents) and lower case."""

PLANNING_KEYWORDS = ("quy hoach", "quy hoach su dung dat", "ke hoach su dung dat", "ke hoach", "khsd", "khsdd", "thong tin quy hoach", "loai dat", "thua dat", "to ban do", "muc dich su dung dat", "quy hoach do thi")
LAND_ADMIN_TERMS = ("thu hoi", "dat nong nghiep", "dat phi nong nghiep", "dat chua su dung", "dien tich tu nhien", "don vi hanh chinh", "cong trinh", "du an", "luat dat dai")
STRUCTURAL_TERMS = ("thua dat", "to ban do", "quy hoach", "ke hoach su dung dat", "muc dich su dung dat", "loai dat", "dat o", "hanh lang", "chi gioi", "thu hoi dat", "dat nong nghiep", "dat phi nong nghiep", "dat chua su dung", "dua dat chua su dung vao su dung", "dien tich tu nhien", "don vi hanh chinh", "luat dat dai")
REASON_TERMS = ("quan ly dat dai", "giai phap", "ha tang", "thoat nuoc", "giao thong", "dich vu", "nha o", "do thi hoa", "dan so co hoc", "bai giua", "song hong", "giai phong mat bang")
EXPLANATORY_MARKERS = ("vi sao", "tai sao", "ly do", "nguyen nhan", "do dau", "nhu the nao", "ra sao", "phan tich", "danh gia", "giai thich", "co so", "can cu", "tac dong", "anh huong", "rui ro", "thach thuc", "giai phap", "khuyen nghi", "how", "why", "analysis")
FACT_MARKERS = ("ma ho so", "dossier", "dossier code", "dossiercode", "ap dung cho nam nao", "nam nao", "thuoc khu vuc nao", "khu vuc nao", "thanh pho nao", "thuoc thanh pho nao", "quan nao", "huyen nao", "ten day du", "ten van ban", "tieu de", "title", "noi gi", "neu gi", "dang noi gi", "dang neu gi", "la gi", "bao nhieu", "co bao nhieu", "tong dien tich", "dien tich tu nhien", "thu hoi bao nhieu", "dat nong nghiep", "dat phi nong nghiep", "dat chua su dung", "vi sao", "tai sao", "nhu the nao", "ra sao", "phan tich", "danh gia", "tac dong", "anh huong", "rui ro")
ANALYTICAL_MARKERS = ("phan loai", "phan nhom", "cau thanh", "hinh thanh", "chi tieu", "bien dong", "so voi", "hien trang", "uoc hien trang", "chuyen tiep", "dang ky moi", "da thuc hien", "chua thuc hien", "chua to chuc", "huy bo", "ket qua thuc hien", "dua vao ke hoach", "thuoc doi tuong", "khong thuoc doi tuong", "bao cao thuyet minh", "tong so", "tong cong", "ty le", "tien do", "dau gia quyen su dung dat", "phuong an boi thuong", "tai dinh cu")
CARRY_FORWARD_MARKERS = ("ubnd thanh pho phe duyet", "ket qua thuc hien", "da thuc hien", "du kien thuc hien den", "31/12/2024", "chua to chuc", "chuyen tiep", "chuyen ky sau")
REGISTERED_PLAN_MARKERS = ("dang ky lap danh muc", "tong so cong trinh du an dang ky thuc hien", "tong so cong trinh du an", "ke hoach su dung dat nam 2025 cap huyen", "danh muc cac cong trinh du an thu hoi dat nam 2025", "danh muc cac du an chuyen muc dich", "nghi quyet", "dua vao ke hoach su dung dat")
ENTITY_MARKERS = ("tram y te", "truong thpt", "tru so bo cong an", "44 yet kieu", "ga c10", "ga s12", "nha tang le quoc gia", "tran thanh tong", "bo cong an", "tran binh trong", "tran nhan tong", "f/thpt1", "mai dich", "chuong duong")
#: What a question asks for, by the flags of its profile.
WHY = ("vi sao", "tai sao")
PROJECT_TERMS = ("cong trinh", "du an")
PROJECT_SUBJECTS = ("du an", "cong trinh", "danh muc")
PROJECT_STATES = ("bieu 1a", "nam trong bieu", "cau thanh", "chuyen tiep", "da thuc hien", "chua thuc hien", "chua to chuc", "ket qua thuc hien", "dua vao ke hoach", "bao cao thuyet minh", "thong qua")
FOCUS_MARKERS = ("vi sao", "tai sao", "trong diem", "nhan manh", "giai phap")
DEMAND_MARKERS = ("vi sao", "tai sao", "can danh", "can tang", "can them", "nhu cau", "uu tien")
SECTORS = ("dat thuong mai", "thuong mai dich vu", "dat giao thong", "giao thong", "dat o do thi", "dat o tai do thi", "nha o do thi", "nha o")
NETWORKS = ("thoat nuoc", "giao thong", "ung ngap", "ha tang")
TERRAIN = ("vung trung", "dia hinh", "song", "ho", "tieu thoat")
NETWORK_REASONS = ("vi sao", "tai sao", "can", "chu trong", "uu tien")
HOW_MARKERS = ("nhu the nao", "ra sao", "phan tich", "danh gia", "how", "analysis", "vi sao", "tai sao")
AMOUNT_MARKERS = ("bao nhieu", "tong", "tong cong", "ty le", "dien tich")
AMOUNT = r"\b\d+(?:[.,]\d+)?\s*(?:ha|m2|km2)\b"
REASONING_MARKERS = ("vi sao", "tai sao", "ly do", "nguyen nhan", "tac dong", "anh huong", "rui ro", "thach thuc", "giai phap", "khuyen nghi")
PROJECT_REASONS = ("vi sao", "tai sao", "ly do", "nguyen nhan", "do dau")
RESULT_GROUPS = ("ket qua thuc hien", "da thuc hien", "chua thuc hien", "chua to chuc", "chuyen tiep", "chuyen ky sau", "du kien thuc hien", "31 12 2024", "31/12/2024")
DELAY_MARKERS = ("chuyen tiep", "chuyen ky sau", "chua to chuc", "chua thuc hien", "ket qua thuc hien", "sang nam 2025")
#: Wards that stand for their district.
WARDS = {"yen so": "Hoàng Mai", "mai dich": "Cầu Giấy", "chuong duong": "Hoàn Kiếm"}
#: Words that show a Vietnamese text without its accents.
VIETNAMESE = ("toi", "ban", "minh", "muon", "can", "tim", "kiem", "nha", "dat", "canho", "gia", "bao", "nhieu", "o", "tai", "quan", "huyen", "phuong", "duong", "dien", "tich", "phong", "ngu", "phap", "ly", "so", "do", "hop", "dong", "gan", "trung", "tam", "khoang", "trieu", "ty", "co", "khong", "neu", "thi", "va", "voi", "cho", "xin", "giup")
#: Lines of an answer that nobody asked for, what keeps them, and the parts of a line or an end that go.
PRICE_LINES = ("gia ban", "gia thue", "vnd", "trieu", "ty")
PRICE_KEEPS = ("dien tich", "phong ngu", "phong ve sinh", "noi that", "huong", "khong gian", "rong rai", "thoang", "phu hop", "thuan tien")
PRICE_PARTS = (r"(?iU),?\s*gi[aá][^,.;\n]*(?:VND|VNĐ|triệu|trieu|tỷ|ty)(?:/[^\s,.;]+)?", r"(?iU),?\s*\d[\d.,]*\s*(?:triệu|trieu|tỷ|ty)(?:\s*(?:VND|VNĐ))?(?:/[^\s,.;]+)?", r"(?iU),?\s*\d[\d.,]*\s*(?:VND|VNĐ)(?:/[^\s,.;]+)?")
CONTACTS = ("lien he", "so dien thoai", "hotline", "chu nha", "moi gioi")
NEARBY = ("gan", "xung quanh", "tien ich", "cach", "lan can")
SPACIOUS = ("rong rai", "thoang", "khong gian", "dien tich")
SPACIOUS_EXTRAS = ("xung quanh", "benh vien", "sieu thi", "cong vien", "truong hoc", "cho ")
SPACIOUS_KEEPS = ("dien tich", "m2", "phong ngu", "phong ve sinh", "noi that", "huong", "ban cong", "rong rai", "thoang")
LISTING_MARK = r"(?imdU)^\s*=+\s*(?:BẤT\s+ĐỘNG\s+SẢN|BAT\s+DONG\s+SAN)\s+(\d+)\s*=+\s*[-:]*\s*"
ANSWER_HEADERS = (r"(?imdU)^\s*LISTING_ID\s*:\s*\d+\s*$", r"(?imdU)^\s*---\s*[^-\n]+\s*---\s*$")
ANSWER_TAILS = ("Nếu bạn cần thêm", "Nếu cần thêm", "Thông tin này được nêu", "Kế hoạch sử dụng đất hằng năm", "Ke hoach su dung dat hang nam", "If you need more information")
FOLLOW_UP_MARKERS = (" do ", " do?", " do la", " do thi", " nay ", " nay?", " kia", " vay", " nhu vay", "chi tiet nao", "nhung chi tiet nao", "yeu to nao", "nhung diem nao", "nhung tien ich nao")
ANCHOR_MARKERS = ("nha", "can", "bat dong san", "dat", "van phong", "mat bang", "lo dat", "quan", "huyen", "duong", "ngo")
FOLLOW_UP_THINGS = ("can nay", "can nha nay", "nha nay", "ngoi nha nay", "can ho nay", "mat bang nay", "lo dat nay", "bds nay", "bat dong san nay", "tin nay", "chu nha", "lien lac", "lien he", "gan", "quy hoach", "hay co")
LOCATION_MARKERS = ("quan ", "huyen ", "phuong ", "duong ", "ngo ", "dia chi", "ha noi", "ho chi minh")
SUITABILITY_MARKERS = ("phu hop", "hop voi", "nen chon", "co nen", "danh gia", "nhan xet", "loi the", "bat loi", "uu diem", "nhuoc diem", "dap ung", "thuan tien", "hap dan", "nhu the nao", "ra sao")
BUSINESS_MARKERS = ("kinh doanh", "buon ban", "cho thue lai", "mat bang", "van phong", "dong tien", "doanh thu")
INVESTMENT_MARKERS = ("dau tu", "sinh loi", "tiem nang", "tang gia", "giu tien")
STUDY_WORK_MARKERS = ("hoc", "lam viec", "di lam", "truong", "dai hoc", "van phong", "cong ty")
#: Districts with a prefix; the folded name, and the name with its prefix, are its aliases.
DISTRICTS = {
    "Ba Đình": "quan", "Bắc Từ Liêm": "quan", "Cầu Giấy": "quan", "Đan Phượng": "huyen", "Đống Đa": "quan", "Hai Bà Trưng": "quan", "Hà Đông": "quan", "Hoài Đức": "huyen", "Hoàn Kiếm": "quan", "Hoàng Mai": "quan", "Long Biên": "quan",
    "Mê Linh": "huyen", "Nam Từ Liêm": "quan", "Phú Xuyên": "huyen", "Quốc Oai": "huyen", "Sơn Tây": "thi xa", "Tây Hồ": "quan", "Thạch Thất": "huyen", "Thanh Oai": "huyen", "Thanh Trì": "huyen", "Thanh Xuân": "quan",
}
