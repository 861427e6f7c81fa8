"""Chat formatting by a finite-state machine over roles, from a declarative template.

Everything here is DataFrame expressions. A conversation is gathered once (its formatted text
is one value by definition), its turns are ordered, and ``aggregate`` runs the machine over them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """How turns are marked. Every marker contains ``mark``, which escaped texts and roles never contain.

    transitions: (state, role) -> next state; anything else is an error. accepting: states in which
    a conversation may end. loss_roles: roles whose texts are under the loss mask.
    """

    open_turn: str = "<turn "
    after_role: str = " :>\n"
    close_turn: str = "<turn/>\n"
    mark: str = "<"
    escape: str = "\\"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    accepting: tuple[str, ...] = ("answered",)
    transitions: dict = field(
        default_factory=lambda: {
            ("start", "system"): "briefed",
            ("start", "user"): "asked",
            ("briefed", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )

    def escaped(self, text: Column) -> Column:
        """Reversible: the escape becomes escape + "e", and then the mark escape + "m"; neither is left bare."""
        return F.replace(F.replace(text, F.lit(self.escape), F.lit(self.escape + "e")), F.lit(self.mark), F.lit(self.escape + "m"))

    def unescaped(self, text: Column) -> Column:
        return F.replace(F.replace(text, F.lit(self.escape + "m"), F.lit(self.mark)), F.lit(self.escape + "e"), F.lit(self.escape))

    def step(self, state: Column, role: Column) -> Column:
        out = None
        for (before, on), after in self.transitions.items():
            hit = (state == before) & (role == on)
            out = F.when(hit, F.lit(after)) if out is None else out.when(hit, F.lit(after))
        return out.otherwise(F.lit("error"))


def format_chats(turns: DataFrame, template: ChatTemplate | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation: its segments, its formatted text and whether its turn order is valid.

    Returns conv, n_turns, formatted, segments (array of struct(text, loss): concatenated, their
    texts are ``formatted``; loss is true for the texts of the template's loss roles), valid, and
    first_error (index of the first turn that the machine refuses; n_turns if it ends too early;
    null if valid). Invalid conversations are formatted like the others. Turns are ordered by turn
    (null first), then role and text, so ties and repeated rows have one order. A null text or
    role counts as empty; rows with a null conv make one conversation. Other columns are ignored.
    """
    t = template or ChatTemplate()
    rows = turns.select(F.col(f"`{conv}`").alias("conv"), F.struct(F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).alias("one"))
    chats = rows.groupBy("conv").agg(F.sort_array(F.collect_list("one")).alias("turns"))
    machine = F.aggregate(
        "turns",
        F.struct(F.lit(t.start).alias("state"), F.lit(0).alias("seen"), F.lit(None).cast("int").alias("bad")),
        lambda acc, x: F.struct(
            t.step(acc["state"], x["role"]).alias("state"),
            (acc["seen"] + 1).alias("seen"),
            F.when(acc["bad"].isNotNull(), acc["bad"]).when(t.step(acc["state"], x["role"]) == "error", acc["seen"]).alias("bad"),
        ),
    )
    segments = F.flatten(
        F.transform(
            "turns",
            lambda x: F.array(
                F.struct(F.concat(F.lit(t.open_turn), t.escaped(x["role"]), F.lit(t.mark), F.lit(t.after_role)).alias("text"), F.lit(False).alias("loss")),
                F.struct(t.escaped(x["text"]).alias("text"), x["role"].isin(*t.loss_roles).alias("loss")),
                F.struct(F.lit(t.close_turn).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    out = chats.select("conv", F.size("turns").alias("n_turns"), segments.alias("segments"), machine.alias("machine"))
    ended = F.col("machine.state").isin(*t.accepting)
    return out.select(
        F.col("conv").alias(conv),
        F.col("n_turns").cast("long").alias("n_turns"),
        F.array_join(F.col("segments.text"), "").alias("formatted"),
        "segments",
        (F.col("machine.bad").isNull() & ended).alias("valid"),
        F.coalesce(F.col("machine.bad"), F.when(~ended, F.col("n_turns"))).alias("first_error"),
    )


def parse_chats(chats: DataFrame, template: ChatTemplate | None = None, formatted: str = "formatted", segments: str = "segments") -> DataFrame:
    """Reads formatted conversations back: adds parsed and loss_text.

    parsed: array of struct(role, text), read from the formatted text by the template alone.
    loss_text: the unescaped text of all segments whose loss flag is set, end to end; roles do not matter.
    """
    t = template or ChatTemplate()
    # A bare mark stands only in markers, so plain splitting is exact.
    bodies = F.transform(F.split(F.col(formatted), _quoted(t.close_turn)), lambda x: F.split(x, _quoted(t.mark + t.after_role), 2))
    full = F.filter(bodies, lambda x: F.size(x) == 2)
    opened = len(t.open_turn) + 1
    turn = lambda x: F.struct(t.unescaped(F.substr(x[0], F.lit(opened))).alias("role"), t.unescaped(x[1]).alias("text"))
    masked = F.transform(F.filter(F.col(segments), lambda x: x["loss"]), lambda x: t.unescaped(x["text"]))
    return chats.withColumn("parsed", F.transform(full, turn)).withColumn("loss_text", F.array_join(masked, ""))


def _quoted(literal: str) -> str:
    return "\\Q" + literal + "\\E"


def chat_digests(chats: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Digests of what parse_chats has read: turns, and the texts under the loss mask."""
    whole = F.array_join(F.transform("parsed", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return chats.select(
        conv,
        F.size("parsed").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
