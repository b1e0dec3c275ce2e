"""Words, patterns and thresholds results depend on.

Everything here must keep exactly these values for results to be right.  Patterns
are Java regular expressions; ``(?iU)`` makes case and ``\\b`` follow Unicode.
"""

# The characters that ``(?U)\\s`` matches.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

# Cell kinds.
NUMBER = r"^[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?$"
GROUPED_NUMBER = r"^[+-]?\d{1,3}(?:,\d{3})+(?:\.\d+)?$"
LEADING_ZERO = r"^[+-]?0\d"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}.*)?$"
ERROR_LITERAL = r"^#(?:DIV/0!|N/A|NAME\?|NULL!|NUM!|REF!|VALUE!|SPILL!|CALC!)$"
MAX_SAFE_INTEGER = 9_007_199_254_740_991
NUMERIC_TEXT = r"^[+-]?[\d,]*\.?\d+%?$"
CONVERTED_NUMBER = r"^[-+]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?$"
SLASH_DATE = r"^\d{1,2}/\d{1,2}/\d{2,4}$"
YEAR_MONTH = r"^\d{4}-(?:0[1-9]|1[0-2])$"

# Rows that are about the table, not part of it.
TOTAL_ROW = r"(?iU)^(?:grand\s*total|sub\s*-?\s*total|totals?\b|รวม|ยอดรวม|vat\b|ภาษีมูลค่าเพิ่ม)"
NOTE_ROW = (r"(?iU)^\s*(?:หมายเหตุ|note\b|notes\b|remarks?\b|\*|※|ที่มา\s*[:：]|source\s*:|ลงชื่อ|ผู้จัดทำ|ผู้ตรวจสอบ|ผู้อนุมัติ"
            r"|prepared\s+by|checked\s+by|approved\s+by)")
EXACT_TOTAL = ("grand total", "total", "subtotal", "รวม", "รวมทั้งหมด", "ยอดรวม", "รวมย่อย")

# What a column name says about its meaning.
TOTAL_NAME = (r"(?iU)รวม|ยอด|มูลค่า|จำนวนเงิน|ส่วนต่าง|ประหยัด|กำไร|รายได้|ค่าใช้จ่าย|งบ|total|amount|\bamt\b|revenue|sales|income|profit"
              r"|expense|budget|spend|saving|difference|variance|value")
PRICE_NAME = r"(?iU)ราคา|ค่าของ|ค่าแรง|ต่อหน่วย|price|rate|cost|fee|salary"
CURRENCY_NAME = r"(?iU)\(บาท\)|บาท|\bthb\b|\busd\b|฿|\$"
QUANTITY_NAME = r"(?iU)\bqty\b|quantity|\bunits?\b|\bcount\b|orders?|จำนวน|ปริมาณ|ชิ้น"
PERCENT_NAME = r"(?iU)percent|\bpct\b|%|\brate\b|ratio|ร้อยละ|อัตรา|สัดส่วน"
CURRENCY_FORMAT = r"(?iU)฿|\$|€|£|¥|\[\$|บาท"
SCORE_NAME = r"(?iU)score|rating|คะแนน"
NOTE_NAME = r"(?iU)หมายเหตุ|remark|note|comment|flag|ความเห็น|รายละเอียด|description"
UNIT_NAME = r"(?iU)^(?:หน่วย|unit|uom|unit of measure)\b"
ID_NAME = r"(?iU)(?:\bid\b|identifier|\bcode\b|\bsku\b|รหัส|เลขที่|ลำดับ|^no\.?$)"
KEY_NAME = r"(?iU)(?:\bid\b|identifier|\bcode\b|\bkey\b|\bsku\b|รหัส|เลขที่|ลำดับ)"
STRICT_ID_NAME = r"(?iU)(^id$|\bid\b|รหัส|code|sku|เลขที่|identifier)"
STRICT_CODE = r"^(?:0\d+|[A-Za-z]+[-_]\d+)$"
STRICT_NUMBER = r"^[+-]?\d+(\.\d+)?([eE][+-]?\d+)?$"
SUMMARY_SHEET = r"(?i)summary|สรุป|overview|dashboard|ภาพรวม"
CATEGORY_MAX_UNIQUE = 200

# Headers of a benchmark comparison.
AXIS_WORDS = {
    "quantity": ("ปริมาณ", "quantity", "qty"),
    "material": ("ราคาของ", "ค่าของ", "ราคาวัสดุ", "ค่าวัสดุ", "material", "mat unit", "mat "),
    "labour": ("ราคาแรง", "ค่าแรง", "labour", "labor", "lab unit", "lab "),
}
BENCHMARK_WORDS = ("ราคากลาง", "rbp", "dpp", "reference", "benchmark", "budget")
NORMALIZED_WORDS = ("ที่ใช้คำนวณ", "หลังปรับ", "ปรับแล้ว", "normalize", "normalized", "adjusted")
TOTAL_WORDS = ("รวม", "total", "ยอดรวม", "summary cost", "amount")
CATEGORY_WORDS = ("หมวดงาน", "หมวด", "ระบบ", "category", "system", "discipline")
ITEM_WORDS = ("รายการ", "item", "description")
DERIVED_WORDS = ("ส่วนต่าง", "ผลต่าง", "ประหยัด", "เท่า", "diff", "variance", "saving", "ratio", "%", "flag")
OUT_OF_SCOPE_WORDS = ("นอกขอบเขต", "out of scope", "rbp=0")
NOT_QUOTED_WORDS = ("ไม่ได้เสนอ", "not quoted", "no bid")
NOTE_WORDS = ("หมายเหตุ", "remark", "note")
AGGREGATE_SHEET_WORDS = ("summary", "สรุป", "ภาพรวม", "overview", "bridge", "เปรียบเทียบ", "วิเคราะห์", "analysis", " vs ", "แนวทาง")
PARTY_NOISE_WORDS = ("เสนอ", "ที่", "ราคา", "unit", "cost", "price", "(", ")", "/", "หน่วย", "net", "wastage", "%")
VENDOR_LABELS = ("ผู้รับเหมา", "ผู้เสนอราคา", "ผู้เสนองาน", "contractor", "bidder", "vendor", "tenderer")
PROJECT_LABELS = ("โครงการ", "project")
OFFERED_BY = r"ราคาที่(\S{2,30}?)เสนอ"
RATIO_CAP = 20
MIN_LEADER_ITEMS = 5
MIN_TOLERANCE_SAMPLE = 20
DEFAULT_TOLERANCE = 0.15
SAME_BILL = 0.9

# Columns of a bid comparison or an estimate.
BID_ITEM = r"(?iU)รายการ|รายละเอียด|description|ชื่องาน"
BID_ITEM_WEAK = r"(?iU)\bitem\b|งาน"
BID_QUANTITY = r"(?iU)ปริมาณ|จำนวน(?!เงิน)|\bqty\b|quantity"
BID_UNIT = r"(?iU)^\s*(?:หน่วย|unit|uom)\s*\.?\s*$"
BID_CATEGORY = r"(?iU)หมวด|category|ประเภทงาน|ระบบงาน"
BID_UNIT_PRICE = r"(?iU)ต่อหน่วย|/\s*หน่วย|unit\s*price|unit\s*rate|\brate\b|@|ราคา/ชุด"
BID_AMOUNT = r"(?iU)จำนวนเงิน|รวมเงิน|มูลค่า|ราคารวม|เป็นเงิน|amount|total|รวม"
BID_PRICE_WORD = r"(?iU)ราคา|price|cost|ค่า"
BID_MATERIAL = r"(?iU)วัสดุ|ค่าของ|material|\bmat\b"
BID_LABOUR = r"(?iU)ค่าแรง|แรงงาน|labou?r"
BID_BENCHMARK = r"(?iU)ราคากลาง|ราคาเป้าหมาย|เป้าหมาย|budget|target|ประมาณการ|ราคาประเมิน|engineer"
BID_UNIT_WORD = r"(?iU)หน่วย|unit"
BID_LINE_TOTAL = r"(?iU)รวม|total"
VAT_LABEL = r"(?iU)vat|ภาษี"
GRAND_TOTAL = r"(?iU)grand\s*total|รวมทั้งสิ้น|รวมทั้งหมด|ยอดรวมทั้งหมด|รวมทั้งโครงการ|total\s+project|net\s+total"
PARTY_PLACEHOLDER = r"(?iU)บริษัท|จำกัด|co\.?,?\s*ltd\.?|[_\s.\-]"
NO_CATEGORY = "ไม่ระบุหมวด"

# Citations and figures in text.
CITATION = r"(?i)\b(?:EV|BOQ|Q\d*)-\d+\b"
CITATION_GROUP = r"(?i)\s*[(\[]\s*(?:(?:EV|BOQ|Q\d*)-\d+\s*[,;/]?\s*(?:และ\s*)?)+[)\]]"
CITATION_LOOSE = r"(?i)\b(?:EV|BOQ|Q\d*)-\d+\b\s*[,;]?"
FIGURE = r"[+-]?\d[\d,]*(?:\.\d+)?(?:[eE][+-]?\d+)?"

# Dashboard limits.
CHART_TYPES = ("line", "area", "bar", "hbar", "donut", "treemap", "histogram", "scatter")
KPI_AGGREGATES = ("count", "count_distinct", "sum", "avg", "min", "max", "median")
CHART_AGGREGATES = ("count", "sum", "avg", "min", "max")
GRAINS = ("day", "week", "month", "quarter", "year")
CATEGORY_CHARTS = ("bar", "hbar", "donut", "treemap")
MAX_KPIS, MAX_CHARTS, MAX_FILTERS = 6, 8, 5
MAX_TIME_POINTS, SCATTER_POINTS, OPTION_VALUES = 400, 500, 200
MAX_QUESTIONS, MAX_GROUP_ROWS, DEFAULT_GROUP_ROWS = 12, 50, 15
