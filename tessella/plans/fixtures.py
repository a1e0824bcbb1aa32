"""Domain views over the test tables: the same SQL text for Spark and DuckDB but for integer division and the name of the text type."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("orders", "lineitem", "events", "embeddings")

VIEWS = {
    "crops": """SELECT vec_id AS crop_id, (vec_id {div} 10)*4 + CASE WHEN vec_id%10<1 THEN 0 WHEN vec_id%10<3 THEN 1 WHEN vec_id%10<6 THEN 2 ELSE 3 END AS image_id,
        label AS cls, embedding FROM embeddings""",
    "crop_images": "SELECT DISTINCT image_id, (image_id {div} 4)%5=0 AS labeled FROM crops",
    "images": "SELECT o_orderkey AS image_id, o_orderkey%5=0 AS labeled FROM orders",
    "boxes0": """SELECT l_orderkey AS image_id, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk, l_quantity AS q, l_discount AS disc, l_tax AS tax, l_returnflag AS rf,
        l_linestatus AS ls, CAST(l_suppkey%20 AS int) AS cls, CAST(l_quantity AS double)/100 AS w, CAST(1+l_partkey%50 AS double)/100 AS h,
        CAST(l_partkey%97 AS double)/97 AS fx, CAST((l_suppkey*31)%89 AS double)/89 AS fy FROM lineitem""",
    "boxes1": """SELECT *, CAST(row_number() OVER (PARTITION BY image_id ORDER BY ln,pk,sk,q,disc,tax,rf,ls)-1 AS int) AS box_seq, w/2+(1-w)*fx AS xc, h/2+(1-h)*fy AS yc FROM boxes0""",
    "boxes": "SELECT image_id, box_seq, cls, xc, yc, w, h FROM boxes1",
    "preds": """SELECT image_id, box_seq, CASE WHEN ls='O' AND box_seq=0 THEN (cls+1)%20 ELSE cls END AS cls, xc+CAST(tax AS double)*w AS xc, yc, w, h, 0.25D0+7*CAST(disc AS double) AS conf
        FROM boxes1 WHERE rf<>'R'""",
    "fr": "SELECT * FROM (VALUES (20),(30),(40)) t(pct)",
    "splits": """SELECT 'random' AS strategy, pct, image_id FROM images, fr WHERE image_id%10*10 < pct
        UNION ALL SELECT 'distance', pct, image_id FROM images, fr WHERE image_id%10 < 2 OR (pct>20 AND (image_id*7)%10*10 < pct)
        UNION ALL SELECT 'reselect', pct, image_id FROM images, fr WHERE (pct=20 AND image_id%10<2) OR (pct>20 AND (image_id+3)%10*10 < pct)""",
    "per_sample_loss": "SELECT user_id AS im_file, event_id, day(ts) AS epoch, value AS loss_iou, value/10 AS loss_cls, value/100 AS loss_dfl FROM events",
    "results": """SELECT event_type AS run, day(ts) AS epoch, event_id, CASE WHEN event_id%50=0 THEN ' n/a' ELSE concat(' ', CAST(value AS {str})) END AS map_raw,
        value/500 AS p, (user_id%100)/100.0D0 AS r FROM events""",
}
USES = {n: [v for v in VIEWS if v != n and re.search(rf"\b{v}\b", t)] for n, t in VIEWS.items()}


def _chain(names: list[str]) -> list[str]:
    """The views that the named ones need, and themselves, in order."""
    wanted: set[str] = set()
    todo = list(names)
    while todo:
        n = todo.pop()
        if n not in wanted:
            wanted.add(n)
            todo += USES[n]
    return [n for n in VIEWS if n in wanted]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a frame."""
    parts = []
    for n in _chain([name]):
        text = VIEWS[n].format(div="div", str="string").replace("0.25D0", "0.25D").replace("100.0D0", "100.0D")
        for t in TABLES:
            text = re.sub(rf"\bFROM {t}\b", f"FROM parquet.`{sf_dir}/{t}.parquet`", text)
        parts.append(f"{n} AS ({text})")
    return spark.sql(f"WITH {', '.join(parts)} SELECT * FROM {name}")


def oracle(sql: str) -> str:
    """SQL for DuckDB with the views that it names in front."""
    names = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    parts = [f"{n} AS ({VIEWS[n].format(div='//', str='varchar').replace('0.25D0', 'CAST(0.25 AS double)').replace('100.0D0', 'CAST(100 AS double)')})" for n in _chain(names)]
    body = sql.strip()
    if not parts:
        return body
    return f"WITH {', '.join(parts)}" + (", " + body[5:] if body.upper().startswith("WITH ") else " " + body)
