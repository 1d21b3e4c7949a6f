"""Problem 1: the lines of a page that are not part of its main body.

Method: consensus host paths. Stored pages are lines of text without tags, so a line's container is the run of lines of its
kind and its path is the generalised line: kind (sentence, fact, row of links, title), bullet, and its words with numbers,
the host's own name and, in titles that fewer than FRAME_TITLES pages hold, rare words masked. Each container is scored on its page: sentences and facts are body, rows of links
are not, a title is a heading if a sentence or fact follows it and no other title is next to it. The scores vote per path,
within a host and over all hosts, counting each different page once so that copies and chunks don't vote. A sentence is part
of the frame if OWN of its host's pages hold it, or if it comes back over all hosts: if a page has it, AGAIN of the other
pages of its host have it too (of hosts with one page and pages without site, AGAIN of all such pages hold it). Both are
shares, so more hosts or pages don't change them; the counts below are only the least evidence. A title is frame where the
votes of all, or of its host if OWN of the host's pages hold it, don't call it a heading. The pages are then read again with
the winning paths.

Rows with null or empty text have no lines. Rows without site vote and are judged over all hosts. A page seen alone is
judged by its own scores. Chunks take the site and the vote of their parent page; a parent that is no page gives no row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table, written

#: Words of titles stay unmasked if FRAME_TITLES pages and this share of the pages have them: at most a page's mean number of title words / share (they are broadcast).
WORD_SHARE = 0.002
#: Different pages that must hold a title, a short or a long sentence before the world may call it frame; OWN_PAGES of a host before the host may.
FRAME_TITLES, FRAME_SENTENCES, FRAME_LONG, OWN_PAGES = 3, 3, 6, 3
#: Share of a host's pages that makes a path the host's own frame; share of a holder's other pages that makes it frame anywhere (notices: 0.016 and up, sentences that meet by chance: 0).
OWN, AGAIN = 0.5, 0.005
#: Share of the pages where a lone title leads a sentence: a heading's, and what no heading has once SURE pages voted. Lone on less than LONE of its pages is a link.
HEADING, NO_HEADING, SURE, LONE = 0.9, 0.85, 4, 0.08
SENTENCE, FACT, LINKS, TITLE, BLANK = "s", "f", "l", "t", "b"
BULLET = re.compile(r"^\s*(?:[-•»›*·–—▪◦‣]\s+|\(?\d{1,2}[.)]\s+)")
FACT_LINE = re.compile(r"^[^:\d.!?]{2,40}:\s*[^\s\d]{0,3}\d[\d.,]*\s*\S{0,12}$")
ROW = re.compile(r"\S\s+[|/·›»•]\s+\S|\S {2,}\S|^\s*[›»]\s.*/")
END = ".!?।॥۔؟…"
PUNCTUATION = ".,:;!?()"
CLOSERS = "\"'”’»)] \t\r​‌‍﻿"


def kind_of(line: str) -> tuple[str, str]:
    """Kind of a line and its text without bullet."""
    if not line.strip(" \t\r​﻿ "):
        return BLANK, ""
    if FACT_LINE.match(line.strip()):
        return FACT, line.strip()
    body = BULLET.sub("", line, count=1).strip()
    bare = re.sub(r"^[>|]\s*", "", body)
    words = bare.split()
    if len(re.findall(r"\S {2,}\S", body)) >= 2 and not bare.rstrip(CLOSERS).endswith(tuple(END)):
        return LINKS, body
    ends = bare.rstrip(CLOSERS)[-1:] in END and bare.rstrip(CLOSERS) != ""
    sentence = len(words) >= 5 and ends or len(words) >= 9
    if ("©" in line or ROW.search(line)) and not (sentence and len(words) >= 9 and ends):
        if not (sentence and ROW.search(line) and "  " in line and not re.search(r"\s[|/·›]\s", line)):
            return LINKS, body
    if sentence or ends and len(words) >= 3 and bare[:1] not in END and not bare.rstrip(CLOSERS).endswith("?"):
        return SENTENCE, bare
    if re.search(r"[:»›]|[?؟]$", bare):
        return LINKS, body  # a label with its value, a question, an arrow: it leads elsewhere
    return TITLE, body


def site_names(site: str | None) -> list[str]:
    if not site or site != site:
        return []
    name = site.rsplit(".", 1)[0]
    return [name.lower(), name.replace("-", " ").lower()]


def generalised(text: str, names: list[str]) -> str:
    """The text with numbers and the host's own name masked."""
    x = re.sub(r"\d+", "0", text.lower())
    for n in names:
        x = x.replace(n, "@")
    return " ".join(x.split())


def is_rare(word: str, vocabulary: set[str]) -> bool:
    return word.strip(PUNCTUATION) not in vocabulary and "@" not in word and any(c.isalpha() for c in word)


def masked_words(path: str, vocabulary: set[str]) -> str:
    return " ".join("*" if is_rare(w, vocabulary) else w for w in path.split())


def page_lines(text: str | None, names: list[str]) -> list[tuple]:
    """(line_no, kind, bulleted, path without masked words, alone, before body) of the lines that are not blank."""
    if not text:
        return []
    raw = text.split("\n")
    kinds = [kind_of(x) for x in raw]
    full = [i for i, (k, _) in enumerate(kinds) if k != BLANK]
    out = []
    for j, i in enumerate(full):
        k, body = kinds[i]
        before = full[j - 1] if j else None
        after = full[j + 1] if j + 1 < len(full) else None
        bullet = BULLET.match(raw[i]) is not None
        # no other title without bullet is next to it without a blank line between
        plain = lambda k: kinds[k][0] == TITLE and BULLET.match(raw[k]) is None
        alone = not (before is not None and before == i - 1 and plain(before)) and not (after is not None and after == i + 1 and plain(after))
        leads = after is not None and kinds[after][0] in (SENTENCE, FACT)
        out.append((i, k, bullet, generalised(body, names), alone, leads))
    return out


def number(path: str) -> int:
    return xxhash.xxh3_64_intdigest(path) - (1 << 63)


def page_key(text: str) -> Column:
    """The page's longest line, as a hash: copies of a page in other frames have the same."""
    return F.xxhash64(F.array_max(F.transform(F.split(text, "\n"), lambda x: F.struct(F.length(x).alias("n"), F.btrim(x, F.lit(" \t\r")).alias("x"))))["x"])


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_table, row_id, site, page_key, text of the pages and of the chunks of pages; a chunk has the key of its parent."""
    o = table(spark, sf_dir, "passage_occurrence").filter("origin = 'page'").withColumn("page_key", page_key("raw_text"))
    own = o.select(F.lit("passage_occurrence").alias("source_table"), F.col("occurrence_id").alias("row_id"), "site", "page_key", F.col("raw_text").alias("text"))
    parents = o.groupBy(F.col("passage_id").alias("parent_passage_id")).agg(F.min("site").alias("site"), F.min(F.when(F.col("raw_text").isNotNull(), F.col("page_key"))).alias("page_key"))
    c = table(spark, sf_dir, "chunk").select("chunk_id", "text", "parent_passage_id").join(parents, "parent_passage_id")
    return own.unionByName(c.select(F.lit("chunk").alias("source_table"), F.col("chunk_id").alias("row_id"), "site", F.coalesce("page_key", page_key("text")).alias("page_key"), "text"))


def frequent_words(rows: DataFrame) -> set[str]:
    """The words of titles, numbers and names masked, that enough different pages have; chunks and copies of a page count with it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for site, key, t in zip(b["site"], b["page_key"], b["text"]):
                names, words = site_names(site), set()
                for k, body in {kind_of(x) for x in (t or "").split("\n")}:
                    if k == TITLE:
                        words |= {w.strip(PUNCTUATION) for w in generalised(body, names).split()}
                out += [(key, w) for w in words]
            yield pd.DataFrame(out, columns=["page_key", "word"])

    pages_of = rows.select("site", "page_key", "text").mapInPandas(run, "page_key bigint, word string").filter("word <> ''").distinct().groupBy("word").count()
    least = max(FRAME_TITLES, WORD_SHARE * rows.select("page_key").distinct().count())
    return {r.word for r in pages_of.filter(F.col("count") >= least).select("word").collect()}


def judged(rows: DataFrame) -> DataFrame:
    """source_table, row_id, line_no, kind, is_body of every line that is not blank."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(frequent_words(rows))  # bounded by WORD_SHARE

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = shared.value
        for b in batches:
            out = []
            for source, i, site, key, t in zip(b["source_table"], b["row_id"], b["site"], b["page_key"], b["text"]):
                if not t:
                    continue
                names = site_names(site)
                for no, kind, bullet, full, alone, leads in page_lines(t, names):
                    path = masked_words(full, vocabulary) if kind == TITLE else full
                    out.append((source, i, site, key, no, kind, bullet, number(kind + path), number(kind + full), path != full, len(path.split()), alone, leads))
            yield pd.DataFrame(out, columns=["source_table", "row_id", "site", "page_key", "line_no", "kind", "bullet", "path", "full_path", "masked", "n_words", "alone", "leads"])

    schema = "source_table string, row_id bigint, site string, page_key bigint, line_no int, kind string, bullet boolean, path bigint, full_path bigint, masked boolean, n_words int, alone boolean, leads boolean"
    all_lines = written(rows.mapInPandas(lines, schema), "p1-lines")
    # a title that enough pages repeat keeps its own path, however rare its words
    repeated = all_lines.filter("masked").groupBy("full_path").agg(F.countDistinct("page_key").alias("n")).filter(F.col("n") >= FRAME_TITLES).select("full_path", F.lit(True).alias("repeated"))
    all_lines = all_lines.join(repeated, "full_path", "left").withColumns({"path": F.when(F.col("repeated") & F.col("masked"), F.col("full_path")).otherwise(F.col("path")), "masked": F.col("masked") & F.col("repeated").isNull()})
    # one vote of a path for each different page
    votes = all_lines.groupBy("path", "page_key").agg(F.min("site").alias("site"), F.max((F.col("alone") & ~F.col("bullet")).cast("int")).alias("alone"), F.max((F.col("alone") & ~F.col("bullet") & F.col("leads")).cast("int")).alias("heads"))
    # pages of each host; a page alone on its host, or without site, is compared with all such pages
    sizes = all_lines.filter("site is not null").groupBy("site").agg(F.countDistinct("page_key").alias("host_size")).filter("host_size > 1")
    hosts = votes.groupBy("path", "site").agg(F.count("*").alias("n"), F.sum("alone").alias("alone"), F.sum("heads").alias("heads")).join(sizes, "site", "left")
    singles = all_lines.select("site", "page_key").distinct().join(sizes, "site", "left_anti").agg(F.countDistinct("page_key").alias("singles"))
    single = F.col("host_size").isNull()
    world = hosts.groupBy("path").agg(
        F.sum("n").alias("pages"), F.sum("alone").alias("alone_pages"), F.sum("heads").alias("head_pages"),
        F.sum(F.when(~single, F.col("n") - 1)).alias("again"), F.sum(F.when(~single, F.col("host_size") - 1)).alias("others"), F.sum(F.when(single, F.col("n"))).alias("single_pages"),
    ).filter("pages >= 2")
    world = world.crossJoin(F.broadcast(singles))  # one row
    own = hosts.filter((F.col("n") >= OWN_PAGES) & (F.col("n") >= F.col("host_size") * OWN)).select("path", "site", F.col("n").alias("own_pages"), F.col("alone").alias("own_alone"), F.col("heads").alias("own_heads"))
    counts = ["pages", "alone_pages", "head_pages", "again", "others", "single_pages", "singles", "own_pages", "own_alone", "own_heads"]
    seen = all_lines.select("source_table", "row_id", "site", "line_no", "kind", "bullet", "masked", "n_words", "path").join(world, "path", "left").join(own, ["path", "site"], "left").fillna(0, counts)
    template = F.col("own_pages") > 0
    common = (F.col("again") > 0) & (F.col("again") >= F.col("others") * AGAIN) | (F.col("single_pages") >= F.greatest(F.lit(FRAME_SENTENCES), F.col("singles") * AGAIN))
    share = lambda alone, heads: F.col(heads) / F.greatest(alone, F.lit(1))
    no_heading = lambda held, alone, heads: (F.col(held) >= FRAME_TITLES) & ~((F.col(alone) >= F.greatest(F.lit(1.0), F.col(held) * LONE)) & (share(alone, heads) >= HEADING))
    frame = (
        F.when(F.col("kind") == LINKS, True)
        .when(F.col("kind") == FACT, False)
        .when(F.col("kind") == SENTENCE, template | common & (F.col("pages") >= F.when(F.col("n_words") >= 9, FRAME_LONG).otherwise(FRAME_SENTENCES)))
        .when(F.col("masked"), (F.col("alone_pages") >= SURE) & (share("alone_pages", "head_pages") < NO_HEADING))
        .otherwise(no_heading("pages", "alone_pages", "head_pages") | no_heading("own_pages", "own_alone", "own_heads"))
    )
    flagged = seen.select("source_table", "row_id", F.struct("line_no", "kind", "bullet", frame.alias("frame")).alias("x")).groupBy("source_table", "row_id").agg(F.array_sort(F.collect_list("x")).alias("x"))

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for source, i, x in zip(b["source_table"], b["row_id"], b["x"]):
                no, kind = [v["line_no"] for v in x], [v["kind"] for v in x]
                for line, k, body in zip(no, kind, body_lines(no, kind, [v["bullet"] for v in x], [v["frame"] for v in x])):
                    out.append((source, i, line, k, body))
            yield pd.DataFrame(out, columns=["source_table", "row_id", "line_no", "kind", "is_body"])

    return flagged.mapInPandas(again, "source_table string, row_id bigint, line_no int, kind string, is_body boolean")


def body_lines(no: list[int], kind: list[str], bullet: list[bool], frame: list[bool]) -> list[bool]:
    """Which lines of a page are body, given which the votes call frame: sentences and facts, and titles that lead one and stand alone."""
    n = len(no)
    body = [not f and k in (SENTENCE, FACT) for f, k in zip(frame, kind)]
    for i in range(n):
        if kind[i] == TITLE and not frame[i] and not bullet[i] and i + 1 < n and body[i + 1]:
            listed = i > 0 and kind[i - 1] == TITLE and not frame[i - 1] and not bullet[i - 1] and no[i - 1] == no[i] - 1
            if not listed:
                body[i] = True
    return body


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(pages(spark, sf_dir)).filter("not is_body").select("source_table", "row_id", "line_no")


def main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_table, row_id, main_text, body_lines, frame_lines of each page and chunk: its body lines in order, each as it stands. Empty where no line is body, or none at all."""
    rows = pages(spark, sf_dir)
    lines = judged(rows).groupBy("source_table", "row_id").agg(F.array_sort(F.collect_list(F.when(F.col("is_body"), F.col("line_no")))).alias("body"), F.count_if(~F.col("is_body")).alias("frame_lines"))
    x = rows.select("source_table", "row_id", F.split("text", "\n").alias("line")).join(lines, ["source_table", "row_id"], "left")
    text = F.array_join(F.transform("body", lambda i: F.get("line", i)), "\n")
    return x.select("source_table", "row_id", F.coalesce(text, F.lit("")).alias("main_text"), F.coalesce(F.size("body"), F.lit(0)).alias("body_lines"), F.coalesce("frame_lines", F.lit(0)).alias("frame_lines"))
