"""Text rebuilt from items and boxes; conversations play the page items."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlake.functions import geometry as g
from reviewlake.operators import layout as ly
from reviewlake.plans.registry import ORACLES, query, table
from reviewlake.plans.values import _RECTS, _WHOLE_RECTS, rects, whole_rects

# Every third item ends in a hyphen, so that it takes in the next one.
_ITEMS = """
    items AS (SELECT conv_id, turn, role, CASE WHEN (conv_id + turn) % 3 = 0 THEN text || '- ' ELSE text END
                AS text FROM conversations),
    marked AS (SELECT *, CASE WHEN lag(role) OVER w = role THEN 0 ELSE 1 END AS starts FROM items
               WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    numbered AS (SELECT *, sum(starts) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM marked)
"""


def _items(spark, folder):
    hyphen = F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, F.lit("- ")).otherwise(F.lit(""))
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", "role", F.concat("text", hyphen).alias("text")
    )


# What an item adds to its run, given the items before and after.
_PIECES = r"""
    flagged AS (SELECT *, regexp_matches(text, '-\s*$') AS hyphen, lag(regexp_matches(text, '-\s*$')) OVER v AS glued,
                  first_value({at}) OVER v AS run_start, lead({at}) OVER v IS NULL AS ends
                FROM numbered WINDOW v AS (PARTITION BY {key}, run ORDER BY {at})),
    led AS (SELECT *, CASE WHEN glued IS NULL OR glued THEN regexp_replace(text, '^\s+', '')
                      ELSE chr(10) || text END AS body FROM flagged),
    pieces AS (SELECT *, CASE WHEN ends THEN regexp_replace(body, '\s+$', '')
                 WHEN hyphen THEN regexp_replace(body, '-\s*$', '') ELSE body END AS piece FROM led)
"""


@query(
    f"""
    WITH {_ITEMS}, {_PIECES.format(key="conv_id", at="turn")}
    SELECT conv_id, run_start, role, turn, piece AS text FROM pieces
    """
)
def text_runs(spark, folder):
    return ly.text_runs(_items(spark, folder), ["conv_id"], "turn", kind="role")


# A page has four turns; a turn is one line, and its box has the type of its role.
_TYPED = """
    typed AS (SELECT conv_id AS doc_id, turn // 4 AS page, turn AS seq, text,
                CASE role WHEN 'user' THEN 'Title' ELSE 'Text' END AS box_type
              FROM conversations WHERE role <> 'system' AND length(text) > 20),
    marked AS (SELECT *, CASE WHEN lag(box_type) OVER w = box_type THEN 0 ELSE 1 END AS starts FROM typed
               WINDOW w AS (PARTITION BY doc_id ORDER BY seq)),
    numbered AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY seq) AS run FROM marked)
"""


def _page_items(spark, folder):
    at = (F.col("turn") % 4 * 10).cast("double")
    lines = table(spark, folder, "conversations").select(
        F.col("conv_id").alias("doc_id"),
        F.floor(F.col("turn") / 4).alias("page"),
        F.col("turn").alias("seq"),
        "role",
        "text",
        g.rect(F.lit(0.0), at, F.lit(100.0), at + 8).alias("bounds"),
    )
    boxed = lines.where((F.col("role") != "system") & (F.length("text") > 20))
    kind = F.when(F.col("role") == "user", F.array(F.lit("Text"), F.lit("Title"))).otherwise(
        F.array(F.lit("Figure"), F.lit("Text"))
    )
    # Boxes are measured on an image twice as large as the page.
    boxes = boxed.select(
        "doc_id",
        "page",
        F.col("seq").alias("box_id"),
        kind.alias("types"),
        g.scale(F.col("bounds"), F.lit(2.0), F.lit(2.0)).alias("bounds"),
    )
    sizes = lines.select("doc_id", "page").distinct().select(
        "*",
        F.lit(100.0).alias("width"),
        F.lit(40.0).alias("height"),
        F.lit(200.0).alias("image_width"),
        F.lit(80.0).alias("image_height"),
    )
    items = lines.select("doc_id", "page", "seq", "text", "bounds")
    return items, ly.rescale_boxes(boxes, sizes)


@query(f"WITH {_TYPED} SELECT doc_id, page, seq, text, box_type FROM typed")
def item_types(spark, folder):
    items, boxes = _page_items(spark, folder)
    return ly.item_types(items, boxes)


@query(
    f"""
    WITH {_TYPED}, {_PIECES.format(key="doc_id", at="seq")}
    SELECT doc_id, seq, CASE WHEN box_type = 'Title' AND glued IS NULL THEN chr(10) || chr(10) || '## ' ELSE '' END
      || piece || CASE WHEN box_type = 'Title' AND ends THEN chr(10) || chr(10) ELSE '' END AS text
    FROM pieces
    """
)
def document_text(spark, folder):
    items, boxes = _page_items(spark, folder)
    return ly.document_text(ly.item_types(items, boxes))


@query(
    r"""
    SELECT conv_id AS doc_id, turn AS seq, CAST(10 + turn AS DOUBLE) AS font_size,
      CAST(50 + turn AS DOUBLE) AS x0, round(CAST(800 - 100 * (turn + 1) - (10 + turn) AS DOUBLE), 6) AS y0,
      round(50 + turn + 0.55::DOUBLE * (10 + turn) * length(text), 4) AS x1,
      round(CAST(800 - 100 * (turn + 1) AS DOUBLE), 6) AS y1
    FROM conversations
    WHERE regexp_matches(text, '[\p{L}\p{N}]')
      AND (800 - 100 * (turn + 1) - (10 + turn) / 2.0) / 800 BETWEEN 0.1 AND 0.9
      AND len(list_filter(string_split_regex(lower(text), '[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]+'),
                          lambda w: w <> '' AND w NOT IN ('the', 'of', 'and'))) > 0
    """
)
def placed_text(spark, folder):
    turn = F.col("turn").cast("double")
    one, none = F.lit(1.0), F.lit(0.0)
    glyphs = table(spark, folder, "conversations").select(
        F.col("conv_id").alias("doc_id"),
        F.floor(F.col("turn") / 4).alias("page"),
        F.col("turn").alias("seq"),
        "text",
        F.array(one * 2, none, none, one * 2, F.lit(10.0) + turn, F.lit(20.0)).alias("user_matrix"),
        F.array(one, none, none, one, F.lit(20.0), turn * 50 + 40).alias("text_matrix"),
        ((F.lit(10.0) + turn) / 2).alias("font_size"),
        F.lit(None).cast("array<double>").alias("font_bbox"),
        F.lit(None).cast("int").alias("first_char"),
        F.lit(None).cast("array<double>").alias("widths"),
        F.lit(800.0).alias("page_height"),
    )
    placed = ly.place_text(glyphs, ["the", "of", "and"])
    return placed.select(
        "doc_id",
        "seq",
        F.round("font_size", 6).alias("font_size"),
        F.round("bounds.x0", 6).alias("x0"),
        F.round("bounds.y0", 6).alias("y0"),
        F.round("bounds.x1", 4).alias("x1"),
        F.round("bounds.y1", 6).alias("y1"),
    )


@query(
    f"""
    WITH RECURSIVE {_RECTS}, pages AS (
      SELECT vec_id // 200 AS doc_id, vec_id // 20 AS page,
        list({{'t': [CASE label % 3 WHEN 0 THEN 'Text' WHEN 1 THEN 'List' ELSE 'Title' END],
              'x0': ax0, 'y0': ay0, 'x1': ax1, 'y1': ay1}} ORDER BY vec_id) AS later
      FROM r JOIN embeddings USING (vec_id) GROUP BY ALL
    ), walk AS (
      SELECT doc_id, page, later[1:0] AS done, later[1:1] AS hand, later[2:] AS later FROM pages
      UNION ALL
      SELECT doc_id, page,
        CASE WHEN hit IS NULL THEN list_concat(done, hand) ELSE done END,
        CASE WHEN hit IS NULL THEN later[1:1] ELSE [{{
          't': list_concat(hand[1].t, list_filter(later[hit].t, lambda t: NOT list_contains(hand[1].t, t))),
          'x0': least(hand[1].x0, later[hit].x0), 'y0': least(hand[1].y0, later[hit].y0),
          'x1': greatest(hand[1].x1, later[hit].x1), 'y1': greatest(hand[1].y1, later[hit].y1)}}] END,
        CASE WHEN hit IS NULL THEN later[2:] ELSE list_concat(later[1:hit - 1], later[hit + 1:]) END
      FROM (SELECT *, list_min(list_filter(range(1, len(later) + 1), lambda i:
          least((hand[1].x1 - hand[1].x0) * (hand[1].y1 - hand[1].y0),
                (later[i].x1 - later[i].x0) * (later[i].y1 - later[i].y0)) > 0
          AND greatest(least(hand[1].x1, later[i].x1) - greatest(hand[1].x0, later[i].x0), 0)
            * greatest(least(hand[1].y1, later[i].y1) - greatest(hand[1].y0, later[i].y0), 0)
            / least((hand[1].x1 - hand[1].x0) * (hand[1].y1 - hand[1].y0),
                    (later[i].x1 - later[i].x0) * (later[i].y1 - later[i].y0)) >= 0.5)) AS hit
        FROM walk WHERE len(hand) > 0)
    ), ended AS (SELECT doc_id, page, done FROM walk WHERE len(hand) = 0)
    SELECT doc_id, page, i - 1 AS box_id, array_to_string(done[i].t, ',') AS types,
      round((done[i].x1 - done[i].x0) * (done[i].y1 - done[i].y0), 5) AS area
    FROM (SELECT *, unnest(range(1, len(done) + 1)) AS i FROM ended)
    """
)
def merged_boxes(spark, folder):
    """Order-dependent union of boxes; twenty vectors make a page."""
    return _merged(rects(spark, folder), F.floor(F.col("vec_id") / 20))


def _merged(boxes, page):
    boxes = boxes.select(
        F.floor(F.col("vec_id") / 200).alias("doc_id"),
        page.alias("page"),
        F.col("vec_id").alias("box_id"),
        F.array(F.get(F.array(F.lit("Text"), F.lit("List"), F.lit("Title")), F.col("label") % 3)).alias("types"),
        F.col("a").alias("bounds"),
    )
    return ly.merge_boxes(boxes).select(
        "doc_id",
        "page",
        "box_id",
        F.array_join("types", ",").alias("types"),
        F.round(g.area(F.col("bounds")), 5).alias("area"),
    )


@query(
    ORACLES["merged_boxes"]
    .replace(
        f"{_RECTS},",
        f"""{_WHOLE_RECTS}, fours AS (
      SELECT vec_id, number * 2 AS place, ax0, ay0, ax1, ay1 FROM r
      UNION ALL SELECT vec_id, number * 2 + 1, bx0, by0, bx1, by1 FROM r),""",
    )
    .replace("vec_id // 20 AS page", "vec_id // 20 * 1000 + place AS page")
    .replace("FROM r JOIN embeddings", "FROM fours JOIN embeddings")
)
def merged_boxes_whole(spark, folder):
    """The same over all numbers; every four of twenty vectors make a page."""
    both = whole_rects(spark, folder)
    place = F.col("number") * 2
    fours = both.select("vec_id", "label", place.alias("place"), "a").unionByName(
        both.select("vec_id", "label", (place + 1).alias("place"), F.col("b").alias("a"))
    )
    return _merged(fours, F.floor(F.col("vec_id") / 20) * 1000 + F.col("place"))
