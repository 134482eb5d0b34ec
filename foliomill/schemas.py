"""The tables of the data model."""

TOC = "system string, book string, seq int, level int, heading string, heading_naive string, page int"
ELEMENT = "book string, page int, seq int, top int, left int, font_id string, font_size double, bold boolean, italic boolean, text_full string, text_head string, text_inline string"
FONTSPEC = "book string, font_id string, size double"
SECTION = "book string, sec_seq int, level int, heading string, content array<string>"
LAYOUT = "book string, items array<struct<level: int, heading: string, content: string>>"
SCORE = "book string, system string, metric string, value double, gt_depth int, system_depth int"
PDF_REF = "book string, ref string, kind string, next_ref string, page int"
