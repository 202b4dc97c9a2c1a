"""Ledger extraction from the invoicing star (S7, J6-J8, A6, F5, L1,
X12-X14).

``extract_ledger`` takes the source relations as DataFrames (Parquet,
or ``spark.read.jdbc`` with a partition column) keyed by role name. The
period and lot filters are applied to the invoice relation first, so they
reach the scan (or the JDBC WHERE clause). Join strategies are left to
Spark: small code tables are broadcast automatically by their measured
size, large relations shuffle on their keys.

The source query grouped by invoice id while selecting non-grouped
columns (engine-arbitrary row). Here the row is chosen deterministically:
per invoice, the one with the smallest (detail id, payment id) - a
``min_by`` aggregation, so an invoice with very many detail rows is
reduced map-side before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import LOT_FLOOR

ROLES = ("factura_egresos", "egresos", "factura", "pago_factura", "pago", "tmovimiento", "datosfactura",
         "users", "tipoPago", "factura_siat", "clientes", "siat_sincro_tipo_metodo_pago", "siat_cuis",
         "almacenes")


def currency_label(code: Column) -> Column:
    """1 -> 'BOB', 2 -> '$U$', anything else NULL."""
    return F.when(code == 1, F.lit("BOB")).when(code == 2, F.lit("$U$"))


def payment_label(canceled: Column, paid: Column) -> Column:
    """Canceled first, then paid state 0/1/2."""
    return (F.when(canceled == 1, F.lit("ANULADA"))
             .when(paid == 0, F.lit("NO PAGADA"))
             .when(paid == 1, F.lit("PAGADA"))
             .when(paid == 2, F.lit("PAGO PARCIAL")))


def full_name(first: Column, last: Column) -> Column:
    """X14: 'first last'; NULL if either part is NULL (CONCAT semantics)."""
    return F.concat(first, F.lit(" "), last)


def ledger_filter(factura: DataFrame, start: str, end: str, lot_floor: int = LOT_FLOOR) -> DataFrame:
    """invoice date within [start, end] and lot 0 or >= floor."""
    return factura.filter(F.col("fechaFac").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
                          & ((F.col("lote") == 0) | (F.col("lote") >= lot_floor)))


def one_per_key(df: DataFrame, key: str) -> DataFrame:
    """A relation reduced to one whole row per key (the smallest, columns
    compared in their order), so that joining it cannot multiply rows; a
    map-side combined aggregate."""
    others = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min(F.struct(*others)).alias("__row")).select(key, "__row.*")


#: What a picked detail row brings along: the seller, the movement's sign, the customer's order.
DETAIL = ("sigla", "first_name", "last_name", "clientePedido")


def _of(links: DataFrame, ids: DataFrame | None) -> DataFrame:
    """The links of the invoices ``ids`` (of all, without)."""
    return links if ids is None else links.join(ids, "idFactura", "left_semi")


def picks(t: dict, ids: DataFrame | None = None) -> DataFrame:
    """Per invoice, the detail row and the payment that the grouped source
    query keeps: the smallest detail id among those whose movement and seller
    exist, with what the extract shows of it (``DETAIL``), and for the
    left-joined payments the smallest payment id with NULL first (NULL when
    the invoice has no payment link or a link without payment). Details and
    payments are each looked up in their own relation and meet in one map-side
    combined aggregate over the union of the links, so the detail x payment
    product of an invoice is never formed, and no join is asked for the NULL
    ids that a detail has for a payment. Only ids go through that aggregate;
    the picked detail's columns are looked up afterwards. Also returns how
    many rows that product would have had (``joined_rows``)."""
    col = F.col
    users = t["users"].select(col("id").alias("__seller"), "first_name", "last_name")
    kinds = t["tmovimiento"].select(col("id").alias("__kind"), "sigla")
    moves = t["egresos"].select(col("idegresos").alias("__e"), "tipomov", "vendedor", "clientePedido")
    moves = moves.join(kinds, col("tipomov") == col("__kind")).join(users, col("vendedor") == col("__seller"))
    paid = t["pago"].select(col("idPago").cast("bigint").alias("__p"), "numPago")

    def none(df: DataFrame, name: str) -> Column:
        return F.lit(None).cast(df.schema[name].dataType).alias(name)

    det = _of(t["factura_egresos"].select("idFactura", "idegresos"), ids).join(moves.select("__e"), col("idegresos") == col("__e"))
    pay = _of(t["pago_factura"].select("idFactura", col("idPago").cast("bigint").alias("idPago")), ids) \
        .join(paid, col("idPago") == col("__p"), "left")
    rows = det.select("idFactura", F.lit(True).alias("is_detail"), "__e", none(paid, "__p"), none(paid, "numPago")).unionByName(
        pay.select("idFactura", F.lit(False).alias("is_detail"), none(moves, "__e"), "__p", "numPago"))
    link = ~col("is_detail")
    got = rows.groupBy("idFactura").agg(
        F.count(F.when(col("is_detail"), 1)).alias("__nd"), F.count(F.when(link, 1)).alias("__np"),
        F.count(F.when(link & col("__p").isNull(), 1)).alias("__null"), F.min("__e").alias("idegresos"),
        F.min(F.when(col("__p").isNotNull(), F.struct(col("__p").alias("idPago"), "numPago"))).alias("__pay"))
    paid = F.when(col("__null") == 0, col("__pay"))
    shown = one_per_key(moves.select("__e", *DETAIL), "__e")
    return got.filter("__nd > 0").join(shown, col("idegresos") == col("__e")).select(
        "idFactura", "idegresos", *DETAIL, paid["idPago"].alias("idPago"), paid["numPago"].alias("numPago"),
        (col("__nd") * F.greatest(col("__np"), F.lit(1))).cast("bigint").alias("joined_rows"))


def extract_ledger(t: dict, start: str, end: str, lot_floor: int = LOT_FLOOR,
                   order: bool = True) -> DataFrame:
    """One ledger row per invoice of the period (32 columns).

    Key-first plan: every relation that can hold several rows for an
    invoice is limited to the period's invoice ids and reduced to one row
    before the wide row is assembled: details and payments by
    ``picks``, tax records to the smallest row that has a payment
    method and an active code, payment methods to one row per code. The
    active codes (``siat_cuis``) only have to exist, so they are a
    semi-join. Other relations are joined on their primary keys. No relation
    is read twice but the invoices (rows, and ids for the semi-joins), the
    users (seller, issuer) and what is shown of a picked detail.
    """
    missing = [r for r in ROLES if r not in t]
    if missing:
        raise ValueError(f"missing source relations: {missing}")
    col = F.col
    f = ledger_filter(t["factura"], start, end, lot_floor).alias("f")
    dfa = t["datosfactura"].alias("df")
    ua = t["users"].alias("ua")
    tp = t["tipoPago"].alias("tp")
    c = t["clientes"].alias("c")
    a = t["almacenes"].alias("a")
    ids = ledger_filter(t["factura"], start, end, lot_floor).select("idFactura")

    methods = one_per_key(t["siat_sincro_tipo_metodo_pago"].select("codigoClasificador", "descripcion"), "codigoClasificador")
    active = t["siat_cuis"].filter(col("active") == 1).select(
        col("sucursal").alias("codigoSucursal"), "codigoPuntoVenta")
    siat = (t["factura_siat"].join(ids, col("factura_id") == col("idFactura"), "left_semi")
            .join(active, ["codigoSucursal", "codigoPuntoVenta"], "left_semi")
            .join(methods, col("codigoMetodoPago") == col("codigoClasificador")))
    fs = one_per_key(siat, "factura_id").alias("fs")

    k = picks(t, ids).drop("joined_rows").alias("k")

    inv = (f.join(dfa, col("df.idDatosFactura") == col("f.lote"))
             .join(ua, col("ua.id") == col("f.autor"))
             .join(tp, col("tp.id") == col("f.tipoPago"))
             .join(fs, col("fs.factura_id") == col("f.idFactura"))
             .join(c, col("c.idCliente") == col("f.cliente"))
             .join(a, col("a.idalmacen") == col("f.almacen")))
    j = inv.join(k, col("k.idFactura") == col("f.idFactura"))
    out = j.select(
        col("fs.codigoSucursal").alias("codigoSucursal"),
        col("fs.codigoPuntoVenta").alias("codigoPuntoVenta"),
        col("f.idFactura").alias("idFactura"),
        col("f.lote").alias("lote"),
        col("df.manual").alias("manual"),
        col("f.nFactura").alias("numeroFactura"),
        col("f.fechaFac").alias("fechaFac"),
        col("f.ClienteNit").alias("ClienteNit"),
        col("c.email").alias("emailCliente"),
        col("f.ClienteFactura").alias("ClienteFactura"),
        col("k.sigla").alias("sigla"),
        col("f.total").alias("total"),
        full_name(col("k.first_name"), col("k.last_name")).alias("vendedor"),
        col("f.anulada").alias("estado"),
        col("f.fecha").alias("fecha"),
        col("f.glosa").alias("glosa"),
        col("k.idPago").alias("idPago"),
        col("k.numPago").alias("numPago"),
        col("f.pagada").alias("pagada"),
        col("f.almacen").alias("idAlmacen"),
        col("k.clientePedido").alias("pedido_cliente"),
        currency_label(col("f.moneda")).alias("moneda"),
        payment_label(col("f.anulada"), col("f.pagada")).alias("pagadaF"),
        full_name(col("ua.first_name"), col("ua.last_name")).alias("emisor"),
        col("tp.tipoPago").alias("tipoPago"),
        col("fs.codigoRecepcion").alias("codigoRecepcion"),
        col("fs.cuf").alias("cuf"),
        col("fs.cafc").alias("cafc"),
        col("fs.pedido").alias("pedido_siat"),
        col("fs.descripcion").alias("metodoPago"),
        col("fs.leyenda").alias("leyenda"),
        col("fs.fechaEmision").alias("fechaEmisionSiat"),
        col("a.almacen").alias("almacen"),
    )
    if order:
        out = out.orderBy(F.col("fechaFac").desc(), F.col("numeroFactura").desc(), F.col("idFactura").desc())
    return out


def pick_one_per_invoice(t: dict) -> DataFrame:
    """A6 on its own: per invoice, how many detail x payment rows the joins
    produce and which (detail, payment) the extract keeps (the smallest)."""
    return picks(t).select("idFactura", "joined_rows", "idegresos", "idPago")
