"""Several facts of one business period under a declared policy: sales with refunds and returns, purchases and stock, receipts and receivables, settlements.

Every fact keeps its own grain: facts are checked and summed by themselves before they meet. What cannot be known stays null and spreads only to
what depends on it: a sale without one effective cost has revenue and no margin, a stock key with one unclear purchase has no closing stock.
What takes from something in order (refunds and returns from sale lines, applications from receipts and documents) goes through refused_in_order.
Lines are written by order and line; what speaks of lines is dealt to them, and of lines only narrow columns go to products and costs.

Tables (columns beyond these are ignored; seq is the order in which rows came):
sales: order_id, line, version, day, org_name, sku, quantity, paid, status, unit, customer, channel. products: sku, name, category, unit, per_case,
safety, target_days. orgs: org, name, aliases. costs: sku, start, stop, cost. refunds: refund_id, order_id, line (null: the whole order), day,
amount, status, seq. returns: return_id, order_id, line, sku, unit, day, quantity, status, seq. purchases: receipt_id, org, sku, unit, day, quantity, price, currency,
status. opening_stock: org, sku, quantity, day. adjustments: adjustment_id, org, sku, unit, day, quantity, status. counts: org, sku, day, quantity. settlements:
settlement_id, channel, month, base, commission, delivery, promotion, offset, received, arrives, status. customers: customer, credit, term_days. opening_ar: document,
org, customer, amount, due. receipts: receipt, org, amount, currency, day, status. applications: application, receipt, kind (opening or sale), document, line, amount, day, seq.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions import business as B
from tabloom.functions.expressions import col
from tabloom.operators.aggregate import allocate_last_residual
from tabloom.operators.capacity import refused_in_order
from tabloom.operators.dedup import unique_master
from tabloom.operators.joins import alias_join, interval_join
from tabloom.operators.order import dealt, dry, spread, written_by, written_once

#: Names of the home currency.
HOME = ("CNY", "RMB", "人民币")
#: Fixed value: orders that never came about, whatever a policy says.
NEVER = "取消|失败|未支付|未完成|待支付"
CENTS, PIECES = "decimal(18,2)", "decimal(18,4)"
UNKNOWN, OTHER = "unknown_product", "other_unit"
CRITICAL = ("sku", "day", "org_name", "quantity", "paid", "status", "unit", "customer")


@dataclass(frozen=True)
class Policy:
    """What counts: the period (both days included), statuses of good and bad orders, thresholds of attention."""

    start: date
    cutoff: date
    good: tuple[str, ...]
    bad: tuple[str, ...] = ()
    accepted: str = "accepted"
    received: str = "received"
    approved: str = "approved"
    arrived: str = "arrived"
    stock_multiplier: float | None = None
    ar_ratio: float | None = None


def strict_sum(c: str | Column) -> Column:
    """The sum, null as soon as one value is; 0 of no rows."""
    x = col(c)
    return F.when(F.count(x) == F.count(F.lit(1)), F.coalesce(F.sum(x), F.lit(0)))


def text(c: str) -> Column:
    return F.trim(F.coalesce(col(c).cast("string"), F.lit("")))


def first_reason(*rules: tuple[Column, str]) -> Column:
    """The first rule that holds, null if none does; what is unknown does not hold."""
    return F.coalesce(*[F.when(rule, F.lit(why)) for rule, why in rules])


def latest_versions(rows: DataFrame, keys: list[str], version: str, critical: tuple[str, ...], by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows of the highest version of each key, (keys, reason, rows) of what was left out).

    A key with a version that is no number, or whose highest version differs in critical columns, has no row; of a highest version that
    differs in other columns the smallest row stays; of equal rows all but one are copies, which change nothing in what stays. Rows are dealt
    by key, or by those of the keys that are named, once, and none is carried along more than once.
    """
    names = [c for c in rows.columns if c not in keys]
    known = reduce(lambda a, b: a & b, [text(k) != "" for k in keys])
    v = col(version).try_cast("decimal(18,4)") if dict(rows.dtypes)[version] == "string" else col(version).cast("decimal(18,4)")
    payload = F.struct(*[text(c).alias(c) for c in critical])
    # where the highest version does not clash its rows have one payload, so the smallest by payload and row is the smallest row
    least, most = F.min(F.struct((-v).alias("v"), payload.alias("p"), F.struct(*names).alias("row"))), F.max(F.struct(v.alias("v"), payload.alias("p")))
    top = dealt(rows.where(known), *(by or keys)).groupBy(*keys).agg(F.bool_or(v.isNull()).alias("_odd"), least.alias("_a"), most.alias("_b"))
    kept = top.where(~F.col("_odd") & (F.col("_a.p") == F.col("_b.p"))).select(*keys, "_a.row.*").select(*rows.columns)
    per = dealt(rows.where(known), *(by or keys)).groupBy(*rows.columns).agg(F.count("*").alias("_c"))
    per = per.groupBy(*keys, v.alias("_v")).agg(F.sum("_c").alias("_c"), F.count("*").alias("_n"), F.min(payload).alias("_a"), F.max(payload).alias("_b"))
    per = per.groupBy(*keys).agg(F.sum("_c").alias("_raw"), F.sum("_n").alias("_all"), F.bool_or(F.col("_v").isNull()).alias("_odd"), F.max_by(F.struct("_n", (F.col("_a") != F.col("_b")).alias("clash")), "_v").alias("_top"))
    odd = F.when(F.col("_odd"), F.col("_all")).otherwise(0)
    sound, clash = F.when(F.col("_odd"), 0), F.col("_top.clash")
    why = [("copy", F.col("_raw") - F.col("_all")), ("bad_version", odd), ("superseded", sound.otherwise(F.col("_all") - F.col("_top._n"))), ("conflict", sound.when(clash, F.col("_top._n")).otherwise(0)), ("repeated", sound.when(~clash, F.col("_top._n") - 1).otherwise(0))]
    split = lambda df, why: df.select(*keys, F.explode(F.array(*[F.struct(F.lit(w).alias("reason"), n.cast("long").alias("rows")) for w, n in why])).alias("_x")).select(*keys, "_x.*").where("rows > 0")
    # rows without a key may be many: they are combined before they meet
    lost = rows.where(~known).groupBy(*rows.columns).agg(F.count("*").alias("_c")).groupBy(*keys).agg(F.sum("_c").alias("_raw"), F.count("*").alias("_all"))
    return kept, split(per, why).union(split(lost, [("copy", F.col("_raw") - F.col("_all")), ("missing_key", F.col("_all"))]))


class output(cached_property):
    """Built once, with as many tasks as the lines of sales need."""

    def __get__(self, facts, owner=None):
        if facts is None:
            return super().__get__(facts, owner)
        with spread(next(iter(facts.tables.values())).sparkSession, facts._lines):
            return super().__get__(facts, owner)


class MultiFact:
    """The outputs of a set of tables under a policy; each is built when it is first asked for."""

    def __init__(self, tables: dict[str, DataFrame], policy: Policy):
        self.tables, self.policy = tables, policy

    @cached_property
    def _lines(self) -> int:
        """Rows of sales: all steps on lines get tasks by them, so that what is written in buckets meets what is dealt later."""
        return 0 if dry() or "sales" not in self.tables else self.tables["sales"].count()

    def _rows(self, name: str) -> DataFrame:
        """Whole rows count once."""
        return self.tables[name].distinct()

    def _in_period(self, c: str) -> Column:
        return col(c).between(F.lit(self.policy.start), F.lit(self.policy.cutoff))

    @cached_property
    def products(self) -> DataFrame:
        return unique_master(self.tables["products"].withColumn("sku", F.upper(text("sku"))), ["sku"])

    @cached_property
    def _key(self) -> dict[str, str]:
        """The columns that say which order and line a row is of, with their types: whole numbers stay such, others are trimmed text."""
        kinds = dict(self.tables["sales"].dtypes)
        return dict((c, kinds[c]) if kinds[c] in ("tinyint", "smallint", "int", "bigint") else (f"_{c}", "string") for c in ("order_id", "line"))

    def _dealt(self, rows: DataFrame, **columns: str) -> DataFrame:
        """Rows that speak of orders or lines, dealt to these: adds their keys, _to and _at, null where a text is no such number."""
        kinds = dict(zip(("_to", "_at"), self._key.values()))
        for name, c in columns.items():
            x = text(c).try_cast(kinds[name])
            rows = rows.withColumn(name, x if kinds[name] == "string" else F.when(x.cast("string") == text(c), x))
        return dealt(rows, *columns)

    def _same(self, to: str = "_to", at: str = "_at") -> Column:
        order, line = self._key
        return (F.col(order) == F.col(to)) & (F.col(line) == F.col(at))

    @output
    def _versions(self) -> tuple[DataFrame, DataFrame]:
        """Lines in their highest version with their org, and what versions left out."""
        own = [c for c in self._key if c.startswith("_")]
        rows = self.tables["sales"].withColumns({c: text(c[1:]) for c in own}) if own else self.tables["sales"]
        rows, gone = latest_versions(rows, ["order_id", "line", *own], "version", CRITICAL, list(self._key))
        rows = rows.withColumns({"sku": F.upper(text("sku")), "quantity": col("quantity").cast(PIECES), "paid": col("paid").cast(CENTS), "day": col("day").cast("date"), "status": text("status")})
        return alias_join(rows, "org_name", self.tables["orgs"], "org", "name", "aliases"), gone.select("order_id", "line", "reason", "rows")

    def _rules(self) -> list[tuple[Column, str]]:
        """What makes a line invalid, the first that holds being its reason."""
        p = self.policy
        return [
            (F.col("status").isin(*p.bad) | F.col("status").rlike(NEVER), "bad_status"), (~F.col("status").isin(*p.good), "unknown_status"), (F.col("_unit").isNull(), UNKNOWN),
            (F.coalesce(F.col("quantity") <= 0, F.lit(True)), "bad_quantity"), (F.coalesce(F.col("paid") < 0, F.lit(True)), "bad_amount"), (F.col("day").isNull(), "bad_date"),
            (~self._in_period("day"), "outside_period"), (F.col("org").isNull(), "unknown_org"), (text("unit") != text("_unit"), OTHER),
        ]

    @property
    def _units(self) -> DataFrame:
        return self.products.select("sku", F.col("unit").alias("_unit"))

    def _plain_reason(self) -> Column:
        """The first of the rules that need no product; the one on unknown products comes after those on the status and before the others."""
        return first_reason(*[(rule, why) for rule, why in self._rules() if why not in (UNKNOWN, OTHER)])

    def _priced(self, rows: DataFrame) -> DataFrame:
        """Adds reason (of products) and unit_cost to narrow columns of lines that break no other rule."""
        rows = interval_join(rows, self.tables["costs"].withColumn("sku", F.upper(text("sku"))), "sku", "day", "cost", output="unit_cost")
        rows = rows.withColumn("unit_cost", F.when(F.col("unit_cost") >= 0, F.col("unit_cost").cast(PIECES))).join(self._units, "sku", "left")
        return rows.withColumn("reason", first_reason(*[(rule, why) for rule, why in self._rules() if why in (UNKNOWN, OTHER)]))

    @output
    def _sales(self) -> DataFrame:
        """Valid lines, by order and line. What breaks a rule that needs no product is left out before products are looked up."""
        order, line = self._key
        rows = written_by(self._versions[0].withColumn("reason", self._plain_reason()).where("reason is null").drop("reason"), order, line)
        lines = self._priced(rows.select(F.col(order).alias("_to"), F.col(line).alias("_at"), "sku", "day", "unit"))
        lines = dealt(lines.where("reason is null").select("_to", "_at", "unit_cost"), "_to", "_at")
        good = written_by(rows.join(lines, self._same()).drop("_to", "_at"), order, line)
        good = good.withColumn("cost", F.round(F.col("quantity") * F.col("unit_cost"), 2).cast(CENTS)).withColumn("month", F.date_format("day", "yyyy-MM"))
        return good.withColumn("_line", F.concat_ws("\u0001", F.length(text("order_id")), text("order_id"), text("line")))

    @output
    def excluded_sales(self) -> DataFrame:
        """(order_id, line, reason, rows): copies, versions, invalid lines, and valid ones without one effective cost."""
        rows, gone = self._versions
        nil = lambda c: F.lit(None).cast(dict(rows.dtypes)[c]).alias(c)
        out, one = ["order_id", "line", "reason", "rows"], F.lit(1).cast("long").alias("rows")
        rows = rows.select("order_id", "line", self._plain_reason().alias("reason"), one, "sku", "day", "unit", F.lit(True).alias("_kept"))
        rows = written_once(rows.union(gone.select(*out, nil("sku"), nil("day"), nil("unit"), F.lit(False))))
        known = ~F.col("_kept") | F.col("reason").isin("bad_status", "unknown_status")
        bad = rows.where("_kept and reason is not null").where(~known).select(*out, "sku").join(self._units, "sku", "left").withColumn("reason", F.when(F.col("_unit").isNull(), UNKNOWN).otherwise(F.col("reason")))
        priced = self._priced(rows.where("_kept and reason is null").drop("reason", "_kept")).withColumn("reason", F.coalesce("reason", F.when(F.col("unit_cost").isNull(), "no_cost"))).where("reason is not null")
        return rows.where(known).select(*out).union(written_once(bad.select(*out).union(priced.select(*out))))

    @output
    def _refunds(self) -> tuple[DataFrame, DataFrame]:
        """(refund_id, amount, day, reason; null: accepted) and the shares of accepted ones by sale line."""
        p, good, key = self.policy, self._sales, list(self._key)
        rows = dealt(self.tables["refunds"], "refund_id").distinct().withColumns({"amount": col("amount").cast(CENTS), "day": col("day").cast("date")})
        why = first_reason(
            ((text("refund_id") == "") | (F.col("_n") > 1), "key_conflict"), (F.coalesce(B.refund_status("status") != "confirmed", F.lit(True)) | F.col("day").isNull() | F.coalesce(F.col("amount") < 0, F.lit(True)), "not_confirmed"),
            (F.col("day") > F.lit(p.cutoff), "after_cutoff"),
        )
        rows = rows.withColumn("_n", F.count("*").over(Window.partitionBy("refund_id"))).withColumn("reason", why)
        rows = written_by(rows.select("refund_id", "order_id", "line", "day", "amount", "seq", "reason"), "refund_id")
        own = rows.where("reason is null").select("refund_id", "amount", "day", "seq", "order_id", text("line").alias("_want"))
        lines = good.select(*key, text("line").alias("_l"), "_line", F.col("day").alias("_day"), "paid")
        legs = self._dealt(own, _to="order_id").drop("order_id").join(dealt(lines, key[0]), F.col("_to") == F.col(key[0])).where("_want = '' or _want = _l")
        # a refund is of one order, so its legs are where the order is
        legs = allocate_last_residual(legs, ["_to", "refund_id"], "amount", "paid", ["_l"], "share")
        one = Window.partitionBy("_to", "refund_id")
        legs = legs.withColumn("_early", F.max(F.col("day") < F.col("_day")).over(one)).withColumn("_paid", F.sum("paid").over(one))
        legs = written_once(legs.select("refund_id", "seq", *key, "_line", "share", "paid", "_early", "_paid"))
        per = dealt(legs.select("refund_id", "_early", F.coalesce(F.col("_paid") > 0, F.lit(False)).alias("_sold")), "refund_id").groupBy("refund_id").agg(F.bool_or("_early").alias("_early"), F.bool_and("_sold").alias("_sold"))
        refused = dealt(refused_in_order(legs.where("not _early and _paid > 0"), "refund_id", "seq", "_line", "share", "paid"), "refund_id")
        state = rows.join(per, "refund_id", "left").join(refused.withColumn("_bad", F.lit(True)), "refund_id", "left")
        why = F.coalesce("reason", first_reason((F.col("_early").isNull(), "orphan"), (F.col("_early"), "before_sale"), (~F.col("_sold") | F.coalesce("_bad", F.lit(False)), "above_paid")))
        state = written_by(state.select("refund_id", "order_id", "line", "day", "amount", why.alias("reason")), "refund_id")
        legs = dealt(legs.select("refund_id", *key, "share"), "refund_id")
        return state, legs.join(state.where("reason is null").select("refund_id"), "refund_id", "left_semi").select(*key, "share")

    @property
    def refunds(self) -> DataFrame:
        return self._refunds[0]

    @output
    def _returns(self) -> DataFrame:
        """Returns with their reason and reversal, and the key of the line that they are of."""
        p, good, (order, number) = self.policy, self._sales, self._key
        rows = self._dealt(self.tables["returns"], _to="order_id", _at="line").distinct().withColumns({"quantity": col("quantity").cast(PIECES), "day": col("day").cast("date"), "sku": F.upper(text("sku"))})
        line = good.select(F.col(order).alias("_key"), F.col(number).alias("_of"), "_line", F.col("sku").alias("_sku"), F.col("quantity").alias("_sold"), F.col("day").alias("_day"), "unit_cost", "org", F.col("unit").alias("_unit"))
        rows = rows.join(line, (F.col("_to") == F.col("_key")) & (F.col("_at") == F.col("_of")), "left")
        bad = F.col("_sold").isNull() | F.coalesce((F.col("quantity") <= 0) | (F.col("quantity") > F.col("_sold")), F.lit(True)) | (F.col("day") < F.col("_day")) | (F.col("sku") != F.col("_sku")) | (text("unit") != text("_unit"))
        why = first_reason((F.coalesce((text("status") != p.accepted) | ~self._in_period("day"), F.lit(True)), "not_accepted"), (bad, "no_such_sale"))
        rows = written_once(rows.select("return_id", "order_id", "line", "sku", "org", "quantity", "unit_cost", "seq", "_key", "_of", "_line", "_sold", why.alias("reason")))
        refused = dealt(refused_in_order(rows.where("reason is null"), "return_id", "seq", "_line", "quantity", "_sold"), "return_id")
        rows = dealt(rows.drop("seq", "_line", "_sold"), "return_id").join(refused.withColumn("_bad", F.lit(True)), "return_id", "left")
        rows = rows.withColumn("reason", F.coalesce("reason", F.when(F.col("return_id").isNull() | F.coalesce("_bad", F.lit(False)), "above_sold")))
        return rows.withColumn("reversal", F.when(F.col("reason").isNull(), F.round(F.col("quantity") * F.col("unit_cost"), 2).cast(CENTS)))

    @output
    def returns(self) -> DataFrame:
        """(return_id, order_id, line, sku, quantity, reversal, reason; null: accepted)."""
        line = F.concat_ws("\u0001", F.length(text("order_id")), text("order_id"), text("line")).alias("_line")
        return self._returns.select("return_id", "order_id", "line", "sku", "org", "quantity", "reversal", "reason", line)

    @output
    def _changes(self) -> DataFrame:
        """What was refunded and came back of a line, by order and line; lines of which nothing was have no row."""
        nil, (order, line) = lambda kind: F.lit(None).cast(kind), self._key
        back = self._returns.where("reason is null").select(F.col("_key").alias("_to"), F.col("_of").alias("_at"), nil(CENTS).alias("share"), "reversal", F.lit(True).alias("_came"))
        rows = self._refunds[1].select(F.col(order).alias("_to"), F.col(line).alias("_at"), "share", nil(CENTS).alias("reversal"), F.lit(False).alias("_came")).union(back)
        came = F.count_if("_came")
        per = dealt(rows, "_to", "_at").groupBy("_to", "_at").agg(F.sum("share").alias("refund"), F.when(F.count("reversal") == came, F.sum("reversal")).alias("_back"), F.when(came > 0, came).alias("_returns"))
        return written_by(per, "_to", "_at")

    @output
    def _sold(self) -> DataFrame:
        """Valid lines with cost, refund, reversal, net and margin, by order and line; the latter null where a cost is."""
        out = self._sales.join(self._changes, self._same(), "left").drop("_to", "_at")
        zero = F.lit(0).cast(CENTS)
        out = out.withColumn("refund", F.coalesce("refund", zero)).withColumn("reversal", F.when(F.col("_returns").isNull(), zero).otherwise(F.col("_back")).cast(CENTS)).withColumn("net", (F.col("paid") - F.col("refund")).cast(CENTS))
        return out.withColumn("margin", (F.col("net") - F.col("cost") + F.col("reversal")).cast(CENTS)).drop("_back", "_returns")

    @output
    def sales(self) -> DataFrame:
        """Valid lines with their product, cost, refund, reversal, net and margin; the latter null where a cost is."""
        return self._sold.join(self.products.select("sku", F.col("name").alias("product"), "category"), "sku", "left")

    def _arrivals(self, late: bool) -> DataFrame:
        """Rows of purchases that count, or those that do not: each row once."""
        rows = self.tables["purchases"].withColumns({"_receipt": text("receipt_id"), "_sku": F.upper(text("sku"))})
        out = F.coalesce((text("status") != self.policy.received) | ~self._in_period(F.col("day").cast("date")), F.lit(True))
        rows = dealt(rows.where(out if late else ~out), "_receipt", "_sku").distinct()
        return rows.withColumns({"org": text("org"), "unit": text("unit"), "quantity": col("quantity").cast(PIECES), "price": col("price").cast(PIECES)})

    @output
    def _purchases(self) -> DataFrame:
        """Purchases that count, with their pieces, cash or the reason why not."""
        rows = self._arrivals(False).withColumn("_n", F.count("*").over(Window.partitionBy("_receipt", "_sku", "org", "unit")))
        rows = rows.select(F.col("_receipt").alias("receipt_id"), "org", F.col("_sku").alias("sku"), "unit", "quantity", "price", "currency", "_n")
        rows = rows.join(self.products.select("sku", F.col("unit").alias("_base"), F.col("per_case").cast(PIECES).alias("_case")), "sku", "left")
        factor = F.when(F.col("unit") == text("_base"), F.lit(1).cast(PIECES)).when(F.col("unit").isin("箱", "case"), F.col("_case"))
        unclear = F.col("_base").isNull() | F.coalesce(F.col("quantity") <= 0, F.lit(True)) | F.coalesce(factor <= 0, F.lit(True))
        rows = rows.withColumn("reason", first_reason((F.col("_n") > 1, "key_conflict"), (unclear, "unit_unclear")))
        home = F.upper(text("currency")).isin(*HOME) & (F.col("price") >= 0)
        rows = rows.withColumn("pieces", F.when(F.col("reason").isNull(), (F.col("quantity") * factor).cast(PIECES))).withColumn("cash", F.when(F.col("reason").isNull() & home, F.round(F.col("quantity") * F.col("price"), 2).cast(CENTS)))
        return rows.select("receipt_id", "org", "sku", "unit", "pieces", "cash", "reason")

    @output
    def purchases(self) -> DataFrame:
        """(receipt_id, org, sku, unit, pieces in the base unit, cash in the home currency, reason)."""
        nil = lambda kind, name: F.lit(None).cast(kind).alias(name)
        late = self._arrivals(True).select(F.col("_receipt").alias("receipt_id"), "org", F.col("_sku").alias("sku"), "unit", nil(PIECES, "pieces"), nil(CENTS, "cash"), F.lit("not_received").alias("reason"))
        return self._purchases.union(late)

    @output
    def stock(self) -> DataFrame:
        """Roll-forward of each org and sku: opening, bought, sold, returned, adjusted, known, closing (null if anything of the key is unclear), value, cover, count at the cutoff, status."""
        p, key = self.policy, ["org", "sku"]
        opening = self.tables["opening_stock"].distinct().select(text("org").alias("org"), F.upper(text("sku")).alias("sku"), col("quantity").cast(PIECES).alias("opening"), col("day").cast("date").alias("_day"))
        opening = unique_master(opening, key)
        base = self.products.select("sku", F.col("unit").alias("_base"))
        adjusted = self._rows("adjustments").withColumn("sku", F.upper(text("sku"))).join(base, "sku").where((text("status") == p.approved) & self._in_period("day") & (text("unit") == text("_base")) & F.col("quantity").isNotNull())
        move = lambda df, name, q: df.select(text("org").alias("org"), "sku", F.lit(name).alias("_kind"), F.col(q).cast(PIECES).alias("_q"))
        bought = written_once(self._purchases.select(*key, "pieces", "reason"))
        moves = reduce(DataFrame.union, [move(bought.where("reason is null"), "bought", "pieces"), move(self._sales, "sold", "quantity"), move(self._returns.where("reason is null"), "returned", "quantity"), move(adjusted, "adjusted", "quantity")])
        kinds = ("bought", "sold", "returned", "adjusted")
        sums = moves.groupBy(*key).agg(*[F.coalesce(F.sum(F.when(F.col("_kind") == k, F.col("_q"))), F.lit(0)).cast(PIECES).alias(k) for k in kinds])
        unclear = bought.where("reason is not null").select(*key, F.concat(F.lit("purchase_"), "reason").alias("_why")).distinct()
        unclear = unclear.groupBy(*key).agg(F.collect_set("_why").alias("_bought"))
        out = opening.join(sums, key, "full").join(unclear, key, "left")
        out = out.fillna(0, list(kinds))
        notes = F.array_compact(F.array(F.when(F.col("opening").isNull(), F.lit("no_opening")), F.when(F.col("_day") != F.lit(p.start), F.lit("opening_date"))))
        out = out.withColumn("unclear", F.array_join(F.array_sort(F.concat(notes, F.coalesce("_bought", F.array().cast("array<string>")))), "; "))
        out = out.withColumn("known", (F.coalesce("opening", F.lit(0)) + F.col("bought") - F.col("sold") + F.col("returned") + F.col("adjusted")).cast(PIECES)).withColumn("closing", F.when(F.col("unclear") == "", F.col("known")))
        at = self.products.select("sku", F.lit(p.cutoff).alias("_at"), "safety", "target_days")
        at = interval_join(at, self.tables["costs"].withColumn("sku", F.upper(text("sku"))), "sku", "_at", "cost", output="unit_cost").drop("_at")
        out = out.join(at, "sku", "left").withColumn("value", F.round(F.col("closing") * F.col("unit_cost").cast(PIECES), 2).cast(CENTS))
        days = (p.cutoff - p.start).days + 1
        cover = F.when(F.col("sold") > 0, F.when(F.col("closing") > 0, F.col("closing")).otherwise(F.col("closing") * 0).cast("double") * days / F.col("sold").cast("double"))
        out = out.withColumn("cover_days", cover)
        per = self._rows("counts").where(col("day").cast("date") <= F.lit(p.cutoff)).groupBy(text("org").alias("org"), F.upper(text("sku")).alias("sku"), col("day").cast("date").alias("_on")).agg(F.min(F.struct(F.col("quantity").isNull().alias("n"), col("quantity").cast(PIECES).alias("q"))).alias("_a"), F.max(F.struct(F.col("quantity").isNull().alias("n"), col("quantity").cast(PIECES).alias("q"))).alias("_b"))
        last = per.groupBy(*key).agg(F.max("_on").alias("counted_on"), F.max_by(F.struct("_a", "_b"), "_on").alias("_c"))
        out = out.join(last, key, "left")
        clash = F.col("_c._a") != F.col("_c._b")
        out = out.withColumn("counted", F.when(~clash, F.col("_c._a.q"))).withColumn("count_gap", F.when(F.col("counted_on") == F.lit(p.cutoff), F.col("counted") - F.col("closing")).cast(PIECES))
        out = out.withColumn("count_basis", F.when(clash, "conflict").when(F.col("counted_on").isNull(), "none").when(F.col("counted_on") == F.lit(p.cutoff), "at_cutoff").otherwise("other_day"))
        over = F.col("cover_days") > F.col("target_days") * p.stock_multiplier if p.stock_multiplier is not None else F.lit(False)
        status = F.coalesce(F.when(F.col("closing").isNull(), "unclear"), F.when(F.col("closing") < 0, "negative"), F.when(F.col("closing") < F.col("safety"), "below_safety"), F.when(over, "overstock"), F.when((F.col("sold") == 0) & (F.col("closing") > 0), "no_sales"), F.lit("normal"))
        return out.withColumn("status", status).select(*key, "opening", *kinds, "known", "closing", "unclear", "unit_cost", "value", "cover_days", "counted_on", "counted", "count_gap", "count_basis", "status")

    @output
    def _openings(self) -> DataFrame:
        opening = unique_master(self._rows("opening_ar").withColumn("document", text("document")), ["document"])
        return opening.select("document", text("org").alias("org"), text("customer").alias("customer"), col("amount").cast(CENTS).alias("base"), col("due").cast("date").alias("due"))

    @output
    def _cash(self) -> tuple[DataFrame, DataFrame]:
        """Applications with their reason and the key of their document, receipts."""
        p, (order, line) = self.policy, self._key
        receipts = unique_master(self._rows("receipts").withColumn("receipt", text("receipt")), ["receipt"]).withColumns({"amount": col("amount").cast(CENTS), "day": col("day").cast("date")})
        receipts = receipts.withColumn("home", F.upper(text("currency")).isin(*HOME)).withColumn("there", F.coalesce((text("status") == p.arrived) & (F.col("day") <= F.lit(p.cutoff)), F.lit(False)))
        a = self.tables["applications"].withColumn("_opening", text("kind") == "opening")
        own = lambda rows: rows.withColumns({"amount": col("amount").cast(CENTS), "day": col("day").cast("date"), "receipt": text("receipt"), "document": text("document")})
        columns = ["application", "seq", "receipt", "_opening", "document", "amount", "day"]
        # what is of a sale goes to its order, the rest to its opening document
        sold = self._sold.select(F.col(order).alias("_key"), F.col(line).alias("_of"), F.concat(F.lit("s"), "_line").alias("_doc"), text("org").alias("_dorg"), F.col("net").alias("_base"), F.col("day").alias("_since"))
        sale = own(self._dealt(a.where("not _opening"), _to="document", _at="line").distinct()).join(sold, (F.col("_to") == F.col("_key")) & (F.col("_at") == F.col("_of")), "left")
        opening = self._openings.select("document", F.concat(F.lit("o"), "document").alias("_doc"), F.col("org").alias("_dorg"), F.col("base").alias("_base"))
        opening = own(a.where("_opening").distinct()).join(opening, "document", "left").withColumns({"_key": F.lit(None).cast(self._key[order]), "_of": F.lit(None).cast(self._key[line]), "_since": F.lit(None).cast("date")})
        found = [*columns, "_key", "_of", "_doc", "_dorg", "_base", "_since"]
        r = receipts.select("receipt", text("org").alias("_rorg"), F.col("amount").alias("_cash"), F.col("day").alias("_arrived"), "home", "there")
        a = sale.select(*found).union(opening.select(*found)).join(r, "receipt", "left")
        unknown = F.col("there").isNull() | F.col("_dorg").isNull() | F.coalesce((F.col("amount") < 0) | (F.col("day") > F.lit(p.cutoff)), F.lit(True)) | ~F.col("there") | ~F.col("home")
        why = first_reason((unknown, "no_match"), ((F.col("_rorg") != F.col("_dorg")) | F.col("_cash").isNull(), "other_org"), ((F.col("day") < F.col("_arrived")) | F.coalesce(F.col("day") < F.col("_since"), F.lit(False)), "too_early"))
        a = written_once(a.select(*columns, "_key", "_of", "_doc", F.col("_dorg").alias("org"), "_base", "_cash", why.alias("reason")))
        ok = a.where("reason is null")
        side = lambda mark, k, room: ok.select("application", "seq", F.concat(F.lit(mark), k).alias("_side"), "amount", F.col(room).alias("_room"))
        refused = refused_in_order(side("r", "receipt", "_cash").union(side("d", "_doc", "_base")), "application", "seq", "_side", "amount", "_room")
        a = a.join(refused.withColumn("_bad", F.lit(True)), "application", "left").withColumn("reason", F.coalesce("reason", F.when(F.col("application").isNull() | F.coalesce("_bad", F.lit(False)), "above_room")))
        return written_once(a.select("application", "receipt", "_opening", "document", "_key", "_of", "amount", "day", "org", "reason")), receipts

    @property
    def applications(self) -> DataFrame:
        return self._cash[0].select("application", "receipt", "amount", "org", "reason")

    @output
    def _open(self) -> tuple[DataFrame, DataFrame]:
        """Opening documents and sale lines with what was applied and what is left."""
        used, key = self._cash[0].where("reason is null"), list(self._key)
        left = lambda rows: rows.withColumn("applied", F.coalesce("applied", F.lit(0)).cast(CENTS)).withColumn("closing", (F.col("base") - F.col("applied")).cast(CENTS))
        opening = self._openings.join(used.where("_opening").groupBy("document").agg(F.sum("amount").alias("applied")), "document", "left")
        per = dealt(used.where("not _opening").select(F.col("_key").alias("_to"), F.col("_of").alias("_at"), "amount"), "_to", "_at").groupBy("_to", "_at").agg(F.sum("amount").alias("applied"))
        sold = self._sold.select(*dict.fromkeys([*key, "order_id", "line"]), "org", "customer", F.col("net").alias("base"), "day").join(per, self._same(), "left")
        return left(opening), left(sold).select("order_id", "line", "org", "customer", "base", "day", "applied", "closing")

    @output
    def receivables(self) -> DataFrame:
        """Documents with what was applied, what is left and how many days it is overdue."""
        opening, sold = self._open
        term = unique_master(self.tables["customers"].withColumn("customer", F.upper(text("customer"))), ["customer"]).select(F.col("customer").alias("_customer"), "term_days")
        sold = sold.withColumn("_customer", F.upper(text("customer"))).join(term, "_customer", "left").withColumn("due", F.date_add("day", F.col("term_days").cast("int")))
        rows = lambda df, kind, document, line: df.select(F.lit(kind).alias("kind"), document.alias("document"), line.alias("line"), text("org").alias("org"), text("customer").alias("customer"), "base", "due", "applied", "closing")
        out = rows(opening, "opening", F.col("document"), F.lit("")).union(rows(sold, "sale", text("order_id"), text("line")))
        return out.withColumn("overdue_days", F.when(F.col("due").isNotNull(), F.greatest(F.datediff(F.lit(self.policy.cutoff), "due"), F.lit(0))))

    @output
    def cash(self) -> DataFrame:
        """Receipts with what was applied and, of arrived ones in the home currency, what is not."""
        used = self._cash[0].where("reason is null").groupBy("receipt").agg(F.sum("amount").alias("applied"))
        out = self._cash[1].join(used, "receipt", "left").withColumn("applied", F.coalesce("applied", F.lit(0)).cast(CENTS))
        return out.withColumn("unapplied", F.when(F.col("there") & F.col("home"), (F.col("amount") - F.col("applied")).cast(CENTS))).select("receipt", "org", "amount", "there", "home", "applied", "unapplied")

    @output
    def settlements(self) -> DataFrame:
        """Settlements of the period with all amounts: fees, what does not tie, what is still to come."""
        p = self.policy
        parts = ("base", "commission", "delivery", "promotion", "offset", "received")
        rows = self._rows("settlements").withColumns({c: col(c).cast(CENTS) for c in parts}).withColumn("_on", col("month").cast("date"))
        rows = rows.where(self._in_period("_on") & reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in parts])).withColumn("month", F.date_format("_on", "yyyy-MM"))
        rows = rows.withColumn("fees", (F.col("commission") + F.col("delivery") + F.col("promotion")).cast(CENTS)).withColumn("gap", (F.col("base") - F.col("fees") - F.col("offset") - F.col("received")).cast(CENTS))
        there = F.coalesce((text("status") == p.arrived) & (col("arrives").cast("date") <= F.lit(p.cutoff)), F.lit(False))
        return rows.withColumn("to_come", F.when(there, F.lit(0)).otherwise(F.col("received")).cast(CENTS)).select("settlement_id", "channel", "month", "base", "fees", "offset", "received", "gap", "to_come")

    def _by(self, *keys: str) -> DataFrame:
        """Sums, which shrink before they are shuffled, and orders, of which only the keys are."""
        s = self._sold.groupBy(*keys).agg(*[strict_sum(c).cast(CENTS).alias(c) for c in ("paid", "refund", "net", "cost", "reversal", "margin")])
        n = dealt(self._sold.select(*keys, "order_id"), *keys, "order_id").distinct().groupBy(*keys).agg(F.count("order_id").alias("orders"))
        same = reduce(lambda a, b: a & b, [s[k].eqNullSafe(n[k]) for k in keys])
        s = s.join(n, same).select(*[s[k] for k in keys], "orders", *[c for c in s.columns if c not in keys])
        return s.withColumn("margin_rate", F.when(F.col("net") != 0, F.col("margin").cast("double") / F.col("net").cast("double")))

    @output
    def months(self) -> DataFrame:
        """Sales by the month of the order, refunds also by their own month, fees by that of the settlement; months with any of them."""
        per = self.refunds.where("reason is null").where(self._in_period("day")).groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(F.sum("amount").cast(CENTS).alias("refunded_in"))
        fees = self.settlements.groupBy("month").agg(F.sum("fees").cast(CENTS).alias("fees"))
        out = self._by("month").join(per, "month", "full").join(fees, "month", "full")
        money = [c for c in ("orders", "paid", "refund", "net", "refunded_in", "fees")]
        sold = F.col("paid").isNotNull()
        out = out.withColumns({c: F.when(~sold, F.lit(0).cast(CENTS)).otherwise(F.col(c)) for c in ("cost", "reversal", "margin")}).fillna(0, money)
        return out.withColumn("contribution", (F.col("margin") - F.col("fees")).cast(CENTS))

    @output
    def orgs(self) -> DataFrame:
        """Each org with its sales, open receivables and their share of its net sales; attention above the policy's ratio."""
        due = reduce(DataFrame.union, [df.select(text("org").alias("org"), "closing") for df in self._open]).groupBy("org").agg(F.sum("closing").cast(CENTS).alias("receivable"))
        out = self.tables["orgs"].select(text("org").alias("org"), "name").join(self._by("org"), "org", "left").join(due, "org", "left").fillna(0, ["orders", "paid", "refund", "net", "receivable"])
        out = out.withColumn("ar_share", F.when(F.col("net") != 0, F.col("receivable").cast("double") / F.col("net").cast("double")))
        return out.withColumn("attention", F.coalesce(F.col("ar_share") > self.policy.ar_ratio, F.lit(False)) if self.policy.ar_ratio is not None else F.lit(False))

    @output
    def channels(self) -> DataFrame:
        fees = self.settlements.groupBy("channel").agg(F.sum("fees").cast(CENTS).alias("fees"), F.sum("to_come").cast(CENTS).alias("to_come"))
        out = self._by("channel").join(fees, "channel", "left").fillna(0, ["fees", "to_come"])
        return out.withColumn("contribution", (F.col("margin") - F.col("fees")).cast(CENTS))

    @output
    def items(self) -> DataFrame:
        return self.products.select("sku", F.col("name").alias("product"), "category").join(self._by("sku"), "sku", "left").fillna(0, ["orders", "paid", "refund", "net"])

    @output
    def checks(self) -> DataFrame:
        """(check, gap, ok): receivables roll forward, refund shares are what was refunded, settlements tie, every line has its cost, every key its stock."""
        one = lambda df, name, gap: df.agg(gap.cast("decimal(20,2)").alias("gap")).select(F.lit(name).alias("check"), "gap")
        total = lambda df, c, sign=1: df.select((F.col(c) * sign).cast(CENTS).alias("x"))
        s = F.coalesce(F.sum("x"), F.lit(0))
        roll = reduce(DataFrame.union, [total(self.receivables, "closing"), total(self.receivables.where("kind = 'opening'"), "base", -1), total(self._sold, "net", -1), total(self._cash[0].where("reason is null"), "amount")])
        refunds = total(self.refunds.where("reason is null"), "amount").union(total(self._sold, "refund", -1))
        rows = [one(roll, "receivables", s), one(refunds, "refunds", s), one(self.settlements, "settlements", F.coalesce(F.sum(F.abs("gap")), F.lit(0))), one(self._sold, "costs", F.count_if(F.col("cost").isNull())), one(self.stock, "stock", F.count_if(F.col("closing").isNull()))]
        return reduce(DataFrame.union, rows).withColumn("ok", F.col("gap") == 0)
