"""Chat formatting of reply trees (SQL functions only).

Messages form trees: each has an id and the id of the message it replies to.
A branch is the way from a root to a leaf (a message without replies).

* *Paths*: every message points at its parent; a self-join of the pointers
  with themselves doubles their distance, and adds up the scores on the way, so
  after log2(depth) rounds every message knows its root, its depth and the sum
  of the scores on its branch.  The pointers of each round are kept.
* *Ranking*: the leaves of a root are ranked by the mean score of their branch
  (ties: the smallest leaf id) and the ``branches`` best are chosen.
* *Enumeration*: from the chosen leaves, the kept pointers are joined from the
  longest to the shortest, each time adding to every message found its
  ancestor at that distance.  Every message of a path is met once (the binary
  digits of its distance), so the work is the length of the chosen paths.
* *Format*: each chosen path becomes one text.  A turn is
  ``<|im_start|>role`` newline ``text<|im_end|>`` newline.  In roles and texts a
  backslash is doubled and one is put behind the first character of a control
  string (``CONTROL``), in roles also in front of a newline; ``unescaped`` takes
  this back exactly.  The loss mask lists start and length (code points) of the
  assistant's texts in the formatted text.

How it runs on Spark: pointers are narrow rows, stored after each round; round r
only takes messages at least 2**r deep and the ends of their pointers.  A
message with very many replies is a hot key of the left side of a join, which
Spark splits.  Texts join the chosen paths at the end.  Only a formatted
conversation itself, which is one value, is gathered in one task.

A null text is empty, a null role is the empty role, a null score counts 0; a
null or unknown parent makes a root.  Rows without an id are in no tree (rows
of a table of turns need none).  Rows that repeat an id are turns at the same
place, all kept, by role and text; their links count once, with the smallest
parent and the largest score.  A circle of replies has no root and gives no
conversation.  Texts of any length are formatted whole.  An empty table gives an
empty one.  Other columns, whatever their names, are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripple.llm.common import positions, stored

START, END = "<|im_start|>", "<|im_end|>\n"
# fixed values: control strings of common chat templates
CONTROL = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>",
           "<s>", "</s>", "<unk>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_QUOTED = "|".join(rf"\Q{c}\E" for c in CONTROL)


def escaped(text: Column, role: bool = False) -> Column:
    """``text`` without any control string; with ``role`` also on one line."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    cut = F.regexp_replace(doubled, rf"(?=(?:{_QUOTED}))(.)", r"$1\\")
    return F.replace(cut, F.lit("\n"), F.lit("\\\n")) if role else cut


def unescaped(text: Column) -> Column:
    """What ``escaped`` was given."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def turns(rows: DataFrame, conversation_col: str, turn_col: str, role_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``id, parent, score`` and ``id, name, role, text``: a table of turns as messages that reply to the turn before.

    Turns follow by number, then role, then text; rows equal in all of these are
    turns one after the other.  ``name`` is the conversation (null is one, too).
    Turns are numbered over range partitions, so one of any length is spread.
    """
    own = stored(rows.select(F.monotonically_increasing_id().alias("id"), F.col(conversation_col).alias("name"),
                             F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"),
                             F.col(text_col).cast("string").alias("text")), "turns")
    narrow = own.select("id", "name", "turn", F.coalesce("role", F.lit("")).alias("role"),
                        F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"))
    placed = stored(positions(narrow, ["name"], ["turn", "role", "key"], "ordered-turns").select("id", "name", "pos"), "places")
    before = placed.select(F.col("id").alias("parent"), F.col("name").alias("_name"), (F.col("pos") + 1).alias("_pos"))
    links = placed.join(before, F.col("name").eqNullSafe(F.col("_name")) & (F.col("pos") == F.col("_pos")), "left")
    return links.select("id", "parent", F.lit(0.0).alias("score")), own.select("id", "name", "role", "text")


def pointers(links: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``id, root, depth, total, leaf`` of every message below a root, and the pointers ``id, up`` of each round.

    ``total`` sums the scores from root to message; ``up`` of round r is the
    ancestor at distance 2**r.
    """
    own = stored(links.where("id is not null").groupBy("id").agg(
        F.min("parent").alias("parent"), F.max(F.coalesce(F.col("score").cast("double"), F.lit(0.0))).alias("total")), "messages")
    known = own.select(F.col("id").alias("up"))
    inner = own.select(F.col("parent").alias("_id")).where("_id is not null").distinct()
    cur = own.join(known, F.col("parent") == F.col("up"), "left").join(inner, F.col("id") == F.col("_id"), "left")
    # total and depth cover the message and those up to, but without, the end of its pointer
    cur = stored(cur.select("id", "up", "total", F.col("up").isNotNull().cast("long").alias("depth"),
                            F.col("_id").isNull().alias("leaf"), F.coalesce("up", "id").alias("root"),
                            F.lit(True).alias("moved")), "pointers-0")
    rounds, n = [], own.count()
    ended = cur.where("up is null")
    while not cur.where("up is not null").isEmpty() and (1 << len(rounds)) <= n:
        moving = cur.where("up is not null")
        rounds.append(moving.select("id", "up"))
        # a message at the end of no pointer of this round is at the end of no longer one
        used = moving.select(F.col("up").alias("_id")).distinct()
        ends = cur.join(used, F.col("id") == F.col("_id"), "left_semi")
        state = [F.col("id").alias("_id"), *(F.col(c).alias(f"_{c}") for c in ("up", "total", "depth", "root"))]
        moved = moving.join(ends.select(*state), F.col("up") == F.col("_id")).select(
            "id", F.col("_up").alias("up"), (F.col("total") + F.col("_total")).alias("total"),
            (F.col("depth") + F.col("_depth")).alias("depth"), "leaf", F.col("_root").alias("root"),
            F.lit(True).alias("moved"))
        stay = ends.where("up is null").withColumn("moved", F.lit(False))
        cur = stored(moved.unionByName(stay), f"pointers-{len(rounds)}")
        ended = ended.unionByName(cur.where("moved and up is null"))
    return ended.drop("up", "moved"), rounds


def chosen_paths(links: DataFrame, branches: int = 1) -> DataFrame:
    """``path, place, id``: the messages of each chosen branch; ``path`` is the id of its leaf, the root has place 0."""
    ended, rounds = pointers(links)
    order = F.struct((-F.col("total") / (F.col("depth") + 1)).alias("worse"), F.col("id"))
    leaves = ended.where("leaf").select("root", "id", "depth", order.alias("order"))
    if branches == 1:
        chosen = leaves.groupBy("root").agg(F.min_by(F.struct("id", "depth"), "order").alias("x")).select("x.id", "x.depth")
    else:
        rank = F.row_number().over(Window.partitionBy("root").orderBy("order"))
        chosen = leaves.withColumn("rank", rank).where(F.col("rank") <= branches)
    cur = stored(chosen.select(F.col("id").alias("path"), F.col("depth").alias("place"), "id"), "chosen")
    for r in reversed(range(len(rounds))):
        up = rounds[r].select(F.col("id").alias("_id"), "up")
        above = cur.join(up, F.col("id") == F.col("_id")).select(
            "path", (F.col("place") - (1 << r)).alias("place"), F.col("up").alias("id"))
        cur = stored(cur.unionByName(above), f"paths-{r}")
    return cur


def format_trees(links: DataFrame, contents: DataFrame, branches: int = 1) -> DataFrame:
    """``path, name, n_turns, formatted, loss``: one row for each chosen branch of the trees of ``links``.

    ``links`` has (id, parent, score), ``contents`` (id, name, role, text).
    ``formatted`` is the conversation and ``loss`` an array of (start, length) in
    code points.  ``path`` tells branches apart.
    """
    paths = chosen_paths(links, branches).withColumnRenamed("id", "_id")
    found = contents.join(paths, F.col("id") == F.col("_id"))
    return formatted(found.select("path", "place", "name", *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text"))))


def formatted(rows: DataFrame) -> DataFrame:
    """``path, name, n_turns, formatted, loss`` of rows(path, place, name, role, text)."""
    head = F.concat(F.lit(START), escaped(F.col("role"), True), F.lit("\n"))
    pieces = rows.select("path", "place", "name", "role", F.xxhash64("text").alias("key"), F.length(head).alias("head"),
                         F.concat(head, escaped(F.col("text")), F.lit(END)).alias("piece"))
    upto = Window.partitionBy("path").orderBy("place", "role", "key").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("piece")).over(upto), F.lit(0)).cast("int")
    body = F.struct((F.col("at") + F.col("head")).alias("start"),
                    (F.length("piece") - F.col("head") - len(END)).alias("length"))
    placed = pieces.withColumn("at", start).select("path", "name", F.struct(
        "at", "piece", F.when(F.col("role") == "assistant", body).alias("loss")).alias("x"))
    whole = placed.groupBy("path").agg(F.any_value("name").alias("name"), F.array_sort(F.collect_list("x")).alias("x"))
    return whole.select("path", "name", F.size("x").cast("long").alias("n_turns"),
                        F.array_join("x.piece", "").alias("formatted"), F.array_compact("x.loss").alias("loss"))


def read_back(conversations: DataFrame) -> DataFrame:
    """``conversations`` with ``turns`` (role, text) parsed from the formatted text and ``loss_text``, both unescaped."""
    parts = F.filter(F.split("formatted", r"\Q<|im_end|>\E\n", -1), lambda p: p != "")
    bare = conversations.withColumn("_parts", F.transform(parts, lambda p: F.substring(p, len(START) + 1, F.length(p))))
    role = r"(?s)^((?:[^\\\n]++|\\.)*+)\n(.*)$"
    read = F.transform("_parts", lambda p: F.struct(
        unescaped(F.regexp_extract(p, role, 1)).alias("role"), unescaped(F.regexp_extract(p, role, 2)).alias("text")))
    masked = F.transform("loss", lambda s: F.substring(F.col("formatted"), s["start"] + 1, s["length"]))
    return bare.withColumns({"turns": read, "loss_text": F.transform(masked, unescaped)}).drop("_parts")
