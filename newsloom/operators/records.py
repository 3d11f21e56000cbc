"""Records from report text and listing pages: rows, segments, summaries, tiles, corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Shapes of report lines.
STATION = r"(?:BBC [^,]+|Radio [^,]+|bbc\.co\.uk)"
DAY = r"\d{1,2} \w+ \d{4}"
STAGE1 = r"(.+?)\s+(BBC\s\w+)\s+(\d{2}/\d{2}/\d{4})\s+(.+?)\s+(\d+)"
STAGE2 = r"(.+?)\s+(BBC[\w\s]+)\s+(\d{2}/\d{2}/\d{4})\s+(.+?)\s+([A-z ]*)"
ROW = r"(?m)^(.*?),\s*(BBC [\w\s]+),\s*(\d{1,2}/\d{1,2}/\d{4}),\s*(.*?)\s*(Upheld|Not upheld|Resolved|Closed)$"
TITLE = r"(?m)^(.*?),\s*(BBC [\w\s]+),\s*(\d{1,2} \w+ \d{4})"
COMPLAINT = r"(?s)Complaint\s*\n(.*?)\nOutcome"
OUTCOME = r"(?s)Outcome\s*\n(.*?)\n(?:Further action|Resolved|Partly upheld|Upheld|Not upheld)"
FURTHER = r"(?s)Further action\s*\n(.*?)(?:\n|$)"


def header(*fields: str) -> str:
    """A whole line of fields with commas between."""
    return "^" + r",\s*".join(fields) + "$"


ANY, STATIONS, DAYS = "(.*?)", f"({STATION})", f"({DAY})"
#: Segment headers by kind, in order of trial: the shape, and which groups of it are programme, station and date; 0 for none.
SEGMENTS = {
    "prog_station_date": (header(ANY, STATIONS, DAYS), (1, 2, 3)),
    "prog_date": (header(ANY, DAYS), (1, 0, 2)),
    "station_prog_date": (header(STATIONS, ANY, DAYS), (2, 1, 3)),
    "prog_wip": (r"^(.*?)\s+\(Working title\)$", (1, 0, 0)),
    "red_button": (header("(BBC Red Button(?: text service closure)?)"), (0, 1, 0)),
    "site": (header(ANY, r"bbc\.co\.uk"), (1, 0, 0)),
    "station_data": (header(STATIONS, DAYS), (0, 1, 2)),
    "prog_station_date_simple": (header(ANY, STATIONS, f"{DAYS}?"), (1, 2, 3)),
    "prog_station_date_simple2": (rf"^(.+?),\s*(.+?)(?:,\s*{DAYS})?$", (1, 2, 3)),
    "forgs": (r"^([^,])*,\s([^,])*, (\d{1,2}\s[A-z]*\s\d{4})$", (1, 2, 3)),
    "forgs2": (r"^([^,]*), ([^,]*), (\d{2}[^,]*\d{4})", (1, 2, 3)),
    "forgs3": (r"^([^,]*), ([^,]*), (\d{2}[^,]*)", (1, 2, 3)),
    "forgs4": (r"^([A-z ]*)  ([A-z ]*)  (\d*/\d*/\d*)", (1, 2, 3)),
    "fallback": (header(r"([^,\n]+)", r"([^,\n]+)", r"([0-9][^,\n]*)"), (1, 2, 3)),
}
HEADERS = tuple(SEGMENTS.values())
#: White space of Unicode, with the four separators of ASCII.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# The columns of the master table.
COLUMNS = (
    "Programme", "Service", "Date of Transmission", "Issue", "Outcome", "keywords", "anti-keywords", "Score", "type (HTML/PDF)",
    "url html", "url Pdf", "URL", "time", "item_time", "category", "Page", "row_index",
)
NONE = "N/A"


def all_groups(text: Column, pattern: str, names: list[str]) -> Column:
    """Array of structs with the groups of every match."""
    return F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(k + 1)).alias(n) for k, n in enumerate(names)])


def rows(pages: DataFrame, pattern: str = ROW, names=("programme", "service", "date", "issue", "outcome")) -> DataFrame:
    """(doc_id, page, pos, *names): every match of a row pattern on each page."""
    found = pages.select("doc_id", "page", F.posexplode(all_groups(F.col("text"), pattern, list(names))).alias("pos", "m"))
    return found.select("doc_id", "page", "pos", *[F.col(f"m.{n}") for n in names])


def summaries(pages: DataFrame) -> DataFrame:
    """(doc_id, pos, title, service, date, complaint, outcome, further): the parts between blank lines that have a title."""
    parts = pages.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "").alias("text"))
    parts = parts.select("doc_id", F.posexplode(F.split("text", "\n\n")).alias("pos", "s")).where(F.col("s").rlike(TITLE))
    get = lambda p: F.when(F.col("s").rlike(p), F.trim(F.regexp_extract("s", p, 1))).otherwise(NONE)
    return parts.select("doc_id", "pos", *[F.regexp_extract("s", TITLE, k).alias(n) for k, n in ((1, "title"), (2, "service"), (3, "date"))], get(COMPLAINT).alias("complaint"), get(OUTCOME).alias("outcome"), get(FURTHER).alias("further"))


def segments(pages: DataFrame) -> DataFrame:
    """(doc_id, page, pos, kind, programme, station, date): lines gather in a buffer until it has the shape of a header.

    An ordered fold over the lines of a page; a header empties the buffer. Lines without a comma are tried only against the shapes that
    need none. Only \\n ends a line; letters, digits and white space are those of Unicode.
    """
    strip = lambda c: F.trim(c, F.lit(BLANKS))

    def java(pattern: str) -> str:
        return "(?d)" + pattern.replace(r"\s", f"[{BLANKS}]").replace(r"\w", r"[\p{L}\p{N}_]").replace(r"\d", r"\p{Nd}")

    def kind(s: Column) -> Column:
        """The first kind whose shape a buffer has."""
        first = lambda commas: F.coalesce(*[F.when(s.rlike(java(p)), name) for name, (p, _) in SEGMENTS.items() if commas or "," not in p])
        return F.when(F.contains(s, F.lit(",")), first(True)).otherwise(first(False))

    def step(state, line):
        # arrays of one: what lambdas are given is computed once
        joined = F.array(F.concat_ws(" ", F.nullif(state["buffer"], F.lit("")), line))
        tried = F.transform(joined, lambda s: F.struct(kind(s).alias("kind"), s.alias("line")))
        return F.get(F.transform(tried, lambda t: F.struct(
            F.when(t["kind"].isNull(), t["line"]).otherwise("").alias("buffer"),
            F.when(t["kind"].isNull(), state["out"]).otherwise(F.concat(state["out"], F.array(t))).alias("out"),
        )), F.lit(0))

    empty = F.struct(F.lit("").alias("buffer"), F.array().cast("array<struct<kind:string,line:string>>").alias("out"))
    lines = F.filter(F.transform(F.split("text", "\n"), strip), lambda s: s != "")
    folded = F.aggregate(lines, empty, step, lambda s: s["out"])
    found = pages.select("doc_id", "page", F.posexplode(folded).alias("pos", "s")).select("doc_id", "page", "pos", "s.kind", "s.line")

    def part(n: int) -> Column:
        out = F.lit("")
        for name, (pattern, groups) in SEGMENTS.items():
            if groups[n]:
                out = F.when(F.col("kind") == name, strip(F.regexp_extract("line", java(pattern), groups[n]))).otherwise(out)
        return out

    return found.select("doc_id", "page", "pos", "kind", part(0).alias("programme"), part(1).alias("station"), part(2).alias("date"))


def align(df: DataFrame, columns=COLUMNS) -> DataFrame:
    """The columns of the master table in order; missing ones and nulls are N/A."""
    return df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(NONE)).alias(c) if c in df.columns else F.lit(NONE).alias(c) for c in columns])


def only_if_empty(main: DataFrame, backup: DataFrame, key: str = "doc_id") -> DataFrame:
    """main, and rows of backup for keys that main has none of."""
    return main.unionByName(backup.join(main.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def page_fields(pages: DataFrame, id_col="page_id", html_col="html") -> DataFrame:
    """Programme, service and date from a title block, with later selectors where the title lacks them."""
    h = F.col(html_col)
    text = lambda p: F.nullif(F.trim(F.regexp_replace(F.regexp_extract(h, p, 1), "<[^>]*>|\n", "")), F.lit(""))
    parts = F.split(text(r'(?s)id="block-contact-page-title"[^>]*>(.*?)</(?:div|h1)>'), ",")
    pick = lambda k, *later: F.coalesce(F.nullif(F.trim(F.get(parts, F.lit(k))), F.lit("")), *[text(p) for p in later], F.lit(NONE))
    by_class = lambda c: rf'(?s)class="{c}"[^>]*>(.*?)</'
    return pages.select(id_col, pick(0).alias("programme"), pick(1, by_class("service"), by_class("block-service")).alias("service"), pick(2, by_class("date-transmission"), r"(?s)<time[^>]*>(.*?)</time>").alias("date"))


def corrections(pages: DataFrame, id_col="page_id", html_col="html") -> DataFrame:
    """(id, pos, title, date, correction_text): per second-level heading the paragraphs up to one with an emphasised date."""
    parts = pages.select(id_col, F.posexplode(F.regexp_extract_all(html_col, F.lit(r"(?s)<h2[^>]*>(.*?)(?=<h2|$)"), F.lit(1))).alias("pos", "s"))
    paras = F.regexp_extract_all("s", F.lit(r"(?s)<p[^>]*>(.*?)</p>"), F.lit(1))
    strip = lambda c: F.trim(F.regexp_replace(c, "<[^>]*>", ""))
    place = F.array_position(F.transform(paras, lambda p: p.contains("<em>")), True)
    before = F.when(place > 0, F.slice(paras, F.lit(1), (place - 1).cast("int"))).otherwise(paras)
    date = F.when(place > 0, strip(F.regexp_extract(F.get(paras, (place - 1).cast("int")), r"(?s)<em>(.*?)</em>", 1))).otherwise("No date found")
    return parts.select(id_col, "pos", strip(F.regexp_extract("s", r"(?s)^(.*?)</h2>", 1)).alias("title"), date.alias("date"), F.array_join(F.transform(before, strip), " ").alias("correction_text"))


def tiles(pages: DataFrame, host: str, id_col="page_id", html_col="html", url_col="url", least: int = 4) -> DataFrame:
    """(id, pos, time, link, pdf_link): tiles of listing pages with at least `least` tiles; of a kind the last link of a tile."""
    from newsloom.functions.urls import full_url

    cut = F.regexp_extract_all(html_col, F.lit(r'(?s)(<div class="tile[^"]*".*?)(?=<div class="tile|$)'), F.lit(1))
    found = pages.select(id_col, url_col, cut.alias("tiles")).where(F.size("tiles") >= least).select(id_col, url_col, F.posexplode("tiles").alias("pos", "t")).where(F.col("t").rlike(r'^<div class="[^"]*white-bg'))
    links = found.select(id_col, "pos", F.nullif(F.regexp_extract("t", r'<time[^>]*datetime="([^"]*)"', 1), F.lit("")).alias("time"), F.posexplode(F.regexp_extract_all("t", F.lit(r'<a [^>]*href="([^"]*)"'), F.lit(1))).alias("k", "href"), url_col)
    links = links.withColumn("full", full_url(F.col("href"), F.col(url_col))).where(F.contains("full", F.lit(host)))
    # a link counts where the page shows it first
    links = links.groupBy(id_col, "full").agg(F.min(F.struct("pos", "k", "time")).alias("m")).select(id_col, "full", "m.*")
    is_pdf = F.contains("full", F.lit("pdf"))
    return links.groupBy(id_col, "pos").agg(F.max("time").alias("time"), F.max_by(F.when(~is_pdf, F.col("full")), F.when(~is_pdf, F.col("k"))).alias("link"), F.max_by(F.when(is_pdf, F.col("full")), F.when(is_pdf, F.col("k"))).alias("pdf_link"))
