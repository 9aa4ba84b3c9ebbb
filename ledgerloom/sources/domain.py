"""The business model over the input tables: orders, lines, reviews, readings, operations.

Every function is a lazy DataFrame. Only the joins a caller asks for are made,
so a KPI by region does not pay for the product dimension.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.money import cents, money, net, share_of
from ..operators import quality
from .tables import Tables

# Promise in days by order priority (ours).
PROMISE_DAYS = {"1-URGENT": 5, "2-HIGH": 10, "3-MEDIUM": 20, "4-NOT SPECIFIED": 30, "5-LOW": 45}
CANCELLED, DELIVERED, OPEN = "P", "F", "O"


def ym(d) -> Column:
    d = F.col(d) if isinstance(d, str) else d
    return F.year(d) * 100 + F.month(d)


def promise_days(priority: str = "o_orderpriority") -> Column:
    out = F.lit(None).cast("int")
    for name, days in PROMISE_DAYS.items():
        out = F.when(F.col(priority) == name, days).otherwise(out)
    return out


def lines(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_seq"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        money("l_extendedprice").alias("gross"),
        net("l_extendedprice", "l_discount").alias("price"),
        share_of("l_extendedprice", "l_tax").alias("freight"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_returnflag").alias("return_flag"),
        F.col("l_linestatus").alias("line_status"),
        F.col("l_shipdate").cast("date").alias("ship_date"),
    )


LINE_ORDER = ["ship_date", "product_id", "seller_id", "price", "freight", "line_status", "gross", "quantity", "return_flag"]


def staged_lines(t: Tables) -> DataFrame:
    """One row per (order, line): the last shipped; chosen by aggregation, not by sorting a group."""
    pick = F.max(F.struct(*LINE_ORDER)).alias("m")
    return lines(t).groupBy("order_id", "line_seq").agg(pick).select("order_id", "line_seq", "m.*")


def orders(t: Tables) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return t.orders.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderstatus").alias("status"),
        day.alias("purchase_date"),
        ym(day).alias("ym"),
        money("o_totalprice").alias("total"),
        F.col("o_orderpriority").alias("payment_type"),
        F.date_add(day, promise_days()).alias("promised_date"),
    )


def geography(t: Tables) -> DataFrame:
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("nation_id"), F.col("n_name").alias("state"), F.col("r_name").alias("region")
    )


def customers(t: Tables) -> DataFrame:
    return t.customer.join(geography(t), F.col("c_nationkey") == F.col("nation_id")).select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_name").alias("customer_name"),
        F.col("c_mktsegment").alias("segment"),
        "state",
        "region",
    )


def products(t: Tables) -> DataFrame:
    return t.part.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("brand"),
        money("p_retailprice").alias("list_price"),
    )


def sellers(t: Tables) -> DataFrame:
    g = geography(t).withColumnsRenamed({"state": "seller_state", "region": "seller_region"})
    return t.supplier.join(g, F.col("s_nationkey") == F.col("nation_id")).select(
        F.col("s_suppkey").alias("seller_id"), F.col("s_name").alias("seller_name"), "seller_state", "seller_region"
    )


def order_lines_summary(t: Tables) -> DataFrame:
    """One row per order that has lines, as they come; partial aggregation happens before the shuffle."""
    return summarised(lines(t))


def summarised(of_lines: DataFrame, *more: Column) -> DataFrame:
    return (
        of_lines
        .groupBy("order_id")
        .agg(
            F.count("*").alias("n_lines"),
            # A distinct count would send the lines twice; the sellers of an order are few.
            F.size(F.collect_set("seller_id")).cast("bigint").alias("n_sellers"),
            F.sum("price").alias("items_value"),
            F.sum("freight").alias("freight_value"),
            F.min("ship_date").alias("first_ship"),
            F.max("ship_date").alias("last_ship"),
            *more,
        )
    )


def examined_orders(t: Tables) -> DataFrame:
    """Orders with the sums of their staged lines and, for those that contradict themselves, the ``reason``."""
    facts = summarised(staged_lines(t), F.bool_or(F.col("line_status") == "F").alias("has_delivered_line"))
    out = orders(t).join(facts, "order_id", "left").withColumn("has_delivered_line", F.coalesce("has_delivered_line", F.lit(False)))
    return out.withColumn("reason", quality.quarantine_reason()).drop("has_delivered_line")


def placed_orders(t: Tables) -> DataFrame:
    """Orders beside the nation of their customer. What follows from these columns is added where it is written, not sent."""
    nation = t.customer.select(F.col("c_custkey").alias("customer_id"), F.col("c_nationkey").alias("nation_id"))
    return orders(t).drop(*PROMISE).join(nation, "customer_id", "left").withColumn("has_order", F.lit(True))


def staged_by_order(t: Tables) -> DataFrame:
    """Staged lines, each with the facts of its order (``FACTS``). The lines are sent by order once, which serves the merging
    of doubled lines, these facts and a join by order."""
    pick = F.max(F.struct(*LINE_ORDER)).alias("m")
    staged = lines(t).repartition("order_id").groupBy("order_id", "line_seq").agg(pick).select("order_id", "line_seq", "m.*")
    order = Window.partitionBy("order_id")
    return staged.withColumns({
        "n_lines": F.count("*").over(order), "n_sellers": F.size(F.collect_set("seller_id").over(order)).cast("bigint"),
        "items_value": F.sum("price").over(order), "freight_value": F.sum("freight").over(order),
        "first_ship": F.min("ship_date").over(order), "last_ship": F.max("ship_date").over(order),
        "has_delivered_line": F.bool_or(F.col("line_status") == "F").over(order)})


FACTS = ["n_lines", "n_sellers", "items_value", "freight_value", "first_ship", "last_ship"]
ORDER = ["customer_id", "status", "purchase_date", "ym", "total", "payment_type", "promised_date"]
PROMISE = ["ym", "promised_date"]
PLACE = ["state", "region"]


def judged(t: Tables, staged: DataFrame, how: str) -> DataFrame:
    """Staged lines and orders side by side, with the place and the ``reason`` where the order contradicts itself."""
    out = staged.join(placed_orders(t), "order_id", how).withColumns(
        {c: F.coalesce(c, F.lit(False)) for c in ("has_order", "has_delivered_line")})
    placed = with_place(t, with_promise(out.withColumn("reason", quality.quarantine_reason())))
    return placed.withColumns({c: F.when(F.col("has_order"), F.col(c)) for c in PLACE})


def examined_lines(t: Tables) -> DataFrame:
    """Staged lines beside their order and its customer's place, with the ``reason`` where the order contradicts itself.

    Lines without an order stay; ``has_order`` tells them.
    """
    return judged(t, staged_by_order(t), "left").select(*STAGING["lines"])


STAGING = {
    "lines": ["order_id", "line_seq", *LINE_ORDER, *ORDER, *PLACE, "nation_id", "has_order", "reason"],
    "orders": ["order_id", *ORDER, *FACTS, *PLACE, "nation_id", "reason"],
}


def examined(t: Tables) -> DataFrame:
    """Lines and orders of a load in one pass: ``grain`` is 'lines' or 'orders', and a row has the columns of its grain
    (``STAGING``). An order comes with its first line, or alone if it has none."""
    first = F.row_number().over(Window.partitionBy("order_id").orderBy("line_seq")) == 1
    both = judged(t, staged_by_order(t).withColumns({"has_line": F.lit(True), "first": first}), "full")
    of_order, of_line = F.col("has_order") & F.coalesce("first", F.lit(True)), F.col("has_line")
    grains = F.array_compact(F.array(F.when(of_order, F.lit("orders")), F.when(of_line, F.lit("lines"))))
    out = both.withColumn("grain", F.explode(grains))
    own = {c: F.when(F.col("grain") == g, F.col(c)).alias(c) for g, other in (("lines", "orders"), ("orders", "lines"))
           for c in STAGING[g] if c not in STAGING[other]}
    return out.select(*[own.get(c, F.col(c)) for c in dict.fromkeys(STAGING["lines"] + STAGING["orders"])], "grain")


def held_orders(t: Tables, examined: DataFrame | None = None) -> DataFrame:
    """Orders in quarantine, with the reason. Their lines and reviews follow them. ``examined``: the staging that a load has written."""
    examined = examined if examined is not None else examined_orders(t)
    return examined.filter("reason IS NOT NULL").select(*orders(t).columns, "reason")


def kept_orders(t: Tables) -> DataFrame:
    return examined_orders(t).filter("reason IS NULL").drop("reason")


def with_dimension(df: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Left join: a row whose key the dimension lacks stays, and its names are 'unknown'."""
    texts = {f.name: F.coalesce(f.name, F.lit("unknown")) for f in dimension.schema if f.dataType.typeName() == "string" and f.name != key}
    return df.join(dimension, key, "left").withColumns(texts)


def with_promise(df: DataFrame) -> DataFrame:
    """The columns of an order that follow from its others."""
    return df.withColumns({"ym": ym("purchase_date"), "promised_date": F.date_add("purchase_date", promise_days("payment_type"))})


def with_place(t: Tables, df: DataFrame, nation: str = "nation_id", state: str = "state", region: str = "region") -> DataFrame:
    """State and region of a nation's number. Nations are a table of fixed length: rows carry the number, and get the
    names where they are written."""
    g = geography(t).select(F.col("nation_id").alias(nation), F.col("state").alias(state), F.col("region").alias(region))
    return with_dimension(df, F.broadcast(g), nation)


DIMS = ("customer", "product", "seller")


def sales_rows(t: Tables, examined: DataFrame, dims: tuple[str, ...] = DIMS) -> DataFrame:
    """Examined lines of kept orders beside product and seller, without what follows from these columns (``sales_columns``).

    This is what a writer sends. Sellers are joined without their nation's names, so that Spark knows how small they are.
    """
    out = examined.filter("has_order AND reason IS NULL").drop("has_order", "reason", *PROMISE, *PLACE)
    if "product" in dims:
        out = with_dimension(out, products(t), "product_id")
    if "seller" in dims:
        s = t.supplier.select(F.col("s_suppkey").alias("seller_id"), F.col("s_name").alias("seller_name"), F.col("s_nationkey").alias("seller_nation"))
        out = out.join(s, "seller_id", "left")
    return out


def sales_columns(t: Tables, df: DataFrame, dims: tuple[str, ...] = DIMS) -> DataFrame:
    """``sales_rows`` with all columns of ``v_sales``."""
    out = with_promise(df)
    columns = ["order_id", "line_seq", *LINE_ORDER, *ORDER]
    if "customer" in dims:
        out, columns = with_place(t, out), [*columns, *PLACE]
    if "product" in dims:
        columns += ["category", "brand", "list_price"]
    if "seller" in dims:
        # As in sellers(): one without a known nation is no seller that we know.
        known = geography(t).select(F.col("nation_id").alias("seller_nation"), F.lit(True).alias("_known"), F.col("state").alias("seller_state"), F.col("region").alias("seller_region"))
        out = out.join(F.broadcast(known), "seller_nation", "left").withColumn("seller_name", F.when(F.col("_known"), F.col("seller_name")))
        names = ["seller_name", "seller_state", "seller_region"]
        out, columns = out.withColumns({c: F.coalesce(c, F.lit("unknown")) for c in names}), [*columns, *names]
    return out.select(*columns)


def v_sales(t: Tables, dims: tuple[str, ...] = DIMS, examined: DataFrame | None = None) -> DataFrame:
    """One row per staged line of the orders that were kept, with the dimensions asked for. ``examined``: lines, see ``examined_lines``."""
    if examined is not None:
        return sales_columns(t, sales_rows(t, examined, dims), dims)
    out = staged_lines(t).join(kept_orders(t).select(*orders(t).columns), "order_id")
    if "customer" in dims:
        out = with_dimension(out, customers(t).select("customer_id", "state", "region"), "customer_id")
    if "product" in dims:
        out = with_dimension(out, products(t), "product_id")
    if "seller" in dims:
        out = with_dimension(out, sellers(t), "seller_id")
    return out


def order_rows(examined: DataFrame) -> DataFrame:
    """Examined orders that were kept, without what follows from these columns (``order_columns``)."""
    return examined.filter("reason IS NULL").drop("reason", *PROMISE, *PLACE)


def order_columns(t: Tables, df: DataFrame) -> DataFrame:
    """``order_rows`` with all columns of ``v_orders``."""
    out = with_place(t, with_delivery(with_promise(df)))
    return out.select(*[c for c in dict.fromkeys(["order_id", *df.columns, *ORDER, *DELIVERY, *PLACE]) if c in out.columns and c != "nation_id"])


def v_orders(t: Tables, dims: tuple[str, ...] = ("customer",)) -> DataFrame:
    """One row per order that was kept, with delivery columns (delivery_days, days_late, on_time)."""
    out = with_delivery(kept_orders(t))
    if "customer" in dims:
        out = with_dimension(out, customers(t).select("customer_id", "state", "region"), "customer_id")
    return out


DELIVERY = ["delivered_date", "delivery_days", "days_late", "on_time"]


def with_delivery(df: DataFrame) -> DataFrame:
    delivered = F.when(F.col("status") == DELIVERED, F.col("last_ship"))
    return df.withColumns({
        "delivered_date": delivered,
        "delivery_days": F.datediff(delivered, F.col("purchase_date")),
        "days_late": F.datediff(delivered, F.col("promised_date")),
        "on_time": delivered <= F.col("promised_date"),
    })


def reviews(t: Tables) -> DataFrame:
    """Grain (review, order): a customer's reviews of one day share a review id."""
    value = F.col("value")
    return t.events.select(
        (F.col("user_id") * 100 + F.dayofmonth("ts")).alias("review_id"),
        (F.col("event_id") - F.col("event_id") % 3).alias("order_id"),
        F.col("event_id"),
        F.col("ts").alias("review_ts"),
        (F.lit(1) + F.least(F.lit(4), F.floor(value / 20))).cast("int").alias("score"),
        (F.col("event_type") != "view").alias("has_comment"),
    )


def latest_reviews(t: Tables) -> DataFrame:
    """Each reviewed order's latest review, by aggregation (no per-order sort)."""
    pick = F.max(F.struct("review_ts", "event_id", "review_id", "score", "has_comment")).alias("m")
    return reviews(t).groupBy("order_id").agg(pick).select("order_id", "m.*")


def v_reviews(t: Tables, dims: tuple[str, ...] = ("customer",)) -> DataFrame:
    return latest_reviews(t).join(v_orders(t, dims), "order_id")


def prop_k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def micros(ts: str = "ts") -> Column:
    """Event time as whole microseconds (session zone UTC)."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def readings(t: Tables) -> DataFrame:
    """Sensor readings: tag, time, value; value also as whole hundredths for exact sums."""
    return t.events.select(
        F.col("event_id").alias("reading_id"),
        F.col("event_type").alias("tag"),
        F.col("ts"),
        micros().alias("us"),
        F.col("user_id").alias("station"),
        F.col("value"),
        cents("value").alias("centi"),
        prop_k().alias("k"),
    )


def operations(t: Tables) -> DataFrame:
    """Card and transfer operations with the columns the fraud rules read.

    Every tenth customer is defrauded; a fifth of what such a customer does goes
    through shop 3, so the data holds a common point of compromise. Every third
    customer never complains.
    """
    k = prop_k()
    victim = F.col("user_id") % 10 == 0
    return t.events.select(
        F.col("event_id").alias("op_id"),
        F.col("user_id").alias("customer"),
        F.col("ts"),
        micros().alias("us"),
        F.when(victim & (k % 5 == 0), 3).otherwise(k).alias("shop"),
        (k % 12).alias("city"),
        (k % 7).alias("device"),
        (k % 17).alias("beneficiary"),
        (k % 5).alias("category"),
        F.when(k % 9 == 0, "XX").otherwise("MX").alias("ip_country"),
        (F.col("event_type") == "view").alias("card_present"),
        F.when(F.col("event_type") == "view", "pos")
        .when(F.col("event_type") == "signup", "transfer")
        .otherwise("online")
        .alias("channel"),
        cents("value").alias("amount"),
        ((F.col("event_type") == "error") & victim).alias("is_fraud"),
        ((F.col("event_type") == "click") & (F.col("user_id") % 3 != 0)).alias("is_complaint"),
    )
