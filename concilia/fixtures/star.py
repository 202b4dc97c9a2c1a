"""Invoicing star (the ledger's source relations) derived from the
supplied tables, in Spark and as DuckDB CTE text. ``k`` = o_orderkey."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sql as S
from .views import Tables, auth_code, materialized


def star(t: Tables) -> dict[str, DataFrame]:
    """The source relations, each materialized once per application (they
    are stored source tables in production)."""
    plans: dict = {}

    def build(tt, n):
        if not plans:
            plans.update(build_star(tt))
        return plans[n]

    return {name: materialized(t, f"star_{name}", lambda tt, n=name: build(tt, n)) for name in STAR_NAMES}


STAR_NAMES = ("factura", "factura_egresos", "egresos", "pago_factura", "pago", "tmovimiento", "datosfactura",
              "users", "tipoPago", "factura_siat", "clientes", "siat_sincro_tipo_metodo_pago", "siat_cuis",
              "almacenes")


def build_star(t: Tables) -> dict[str, DataFrame]:
    o, li, p, c = t["orders"], t["lineitem"], t["part"], t["customer"]
    k = F.col("o_orderkey")
    factura = o.select(
        k.alias("idFactura"),
        F.when(k % 4 == 0, F.lit(0)).otherwise(F.lit(130) + k % 16).alias("lote"),
        k.alias("nFactura"),
        F.to_date("o_orderdate").alias("fechaFac"),
        F.col("o_custkey").cast("string").alias("ClienteNit"),
        F.concat(F.lit("Cliente "), F.col("o_custkey").cast("string")).alias("ClienteFactura"),
        F.col("o_totalprice").alias("total"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("anulada"),
        F.col("o_orderdate").alias("fecha"),
        F.when(k % 5 == 0, F.concat(F.lit("nota "), k.cast("string"))).when(k % 5 == 1, F.lit(""))
         .alias("glosa"),
        (k % 3).alias("pagada"),
        (k % 4).alias("almacen"),
        F.when(k % 13 == 0, F.lit(3)).otherwise(F.lit(1) + k % 2).alias("moneda"),
        (F.col("o_custkey") % 100).alias("autor"),
        (k % 3 + 1).alias("tipoPago"),
        F.col("o_custkey").alias("cliente"),
    )
    returns = li.filter(F.col("l_returnflag") == "R")
    pay_id = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return {
        "factura": factura,
        "factura_egresos": li.select(F.col("l_orderkey").alias("idFactura"), F.col("l_partkey").alias("idegresos")),
        "egresos": p.select(F.col("p_partkey").alias("idegresos"), (F.col("p_size") % 3).alias("tipomov"),
                            (F.col("p_partkey") % 100).alias("vendedor"), F.col("p_name").alias("clientePedido")),
        "pago_factura": returns.select(F.col("l_orderkey").alias("idFactura"), pay_id.alias("idPago")),
        "pago": returns.select(pay_id.alias("idPago"), F.col("l_linenumber").alias("numPago")),
        "tmovimiento": p.select((F.col("p_size") % 3).alias("id")).distinct()
                        .withColumn("sigla", F.concat(F.lit("MOV"), F.col("id").cast("string"))),
        "datosfactura": factura.select(F.col("lote").alias("idDatosFactura")).distinct()
                               .withColumn("manual", F.col("idDatosFactura") % 2),
        "users": c.select(F.col("c_custkey").alias("id"),
                          F.when(F.col("c_custkey") % 7 == 0, F.lit(None).cast("string"))
                           .otherwise(F.col("c_mktsegment")).alias("first_name"),
                          F.col("c_name").alias("last_name")),
        "tipoPago": o.select((k % 3 + 1).alias("id")).distinct()
                     .withColumn("tipoPago", F.concat(F.lit("TIPO "), F.col("id").cast("string"))),
        "factura_siat": o.select(
            k.alias("factura_id"), (k % 3).alias("codigoSucursal"), (k % 2).alias("codigoPuntoVenta"),
            F.concat(F.lit("R"), k.cast("string")).alias("codigoRecepcion"), auth_code(k).alias("cuf"),
            F.when(k % 7 == 0, F.concat(F.lit("CAFC"), k.cast("string"))).alias("cafc"),
            F.col("o_orderpriority").alias("pedido"),
            F.concat(F.lit("Ley "), (k % 10).cast("string")).alias("leyenda"),
            F.col("o_orderdate").alias("fechaEmision"), (k % 2 + 1).alias("codigoMetodoPago")),
        "clientes": c.select(F.col("c_custkey").alias("idCliente"),
                             F.concat(F.lower(F.regexp_replace("c_name", "#", ".")), F.lit("@correo.bo"))
                              .alias("email")),
        "siat_sincro_tipo_metodo_pago": o.select((k % 2 + 1).alias("codigoClasificador")).distinct()
            .withColumn("descripcion", F.concat(F.lit("METODO "), F.col("codigoClasificador").cast("string"))),
        "siat_cuis": (o.select((k % 3).alias("sucursal"), (k % 2).alias("codigoPuntoVenta")).distinct()
                       .withColumn("active", F.lit(1))
                       .unionByName(o.select((k % 3).alias("sucursal"), (k % 2).alias("codigoPuntoVenta"))
                                     .distinct().withColumn("active", F.lit(0)))),
        "almacenes": o.select((k % 4).alias("idalmacen")).distinct()
                      .withColumn("almacen", F.concat(F.lit("ALMACEN "), F.col("idalmacen").cast("string"))),
    }


STAR_SQL = f"""factura AS (
  SELECT o_orderkey AS idFactura, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE 130 + o_orderkey % 16 END AS lote,
    o_orderkey AS nFactura, CAST(o_orderdate AS DATE) AS fechaFac, CAST(o_custkey AS VARCHAR) AS ClienteNit,
    'Cliente ' || CAST(o_custkey AS VARCHAR) AS ClienteFactura, o_totalprice AS total,
    CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS anulada, o_orderdate AS fecha,
    CASE WHEN o_orderkey % 5 = 0 THEN 'nota ' || CAST(o_orderkey AS VARCHAR) WHEN o_orderkey % 5 = 1 THEN '' END AS glosa,
    o_orderkey % 3 AS pagada, o_orderkey % 4 AS almacen,
    CASE WHEN o_orderkey % 13 = 0 THEN 3 ELSE 1 + o_orderkey % 2 END AS moneda,
    o_custkey % 100 AS autor, o_orderkey % 3 + 1 AS tipoPago, o_custkey AS cliente
  FROM orders
), factura_egresos AS (SELECT l_orderkey AS idFactura, l_partkey AS idegresos FROM lineitem
), egresos AS (SELECT p_partkey AS idegresos, p_size % 3 AS tipomov, p_partkey % 100 AS vendedor,
    p_name AS clientePedido FROM part
), pago_factura AS (SELECT l_orderkey AS idFactura, l_orderkey * 10 + l_linenumber AS idPago
    FROM lineitem WHERE l_returnflag = 'R'
), pago AS (SELECT l_orderkey * 10 + l_linenumber AS idPago, l_linenumber AS numPago
    FROM lineitem WHERE l_returnflag = 'R'
), tmovimiento AS (SELECT id, 'MOV' || CAST(id AS VARCHAR) AS sigla FROM (SELECT DISTINCT p_size % 3 AS id FROM part)
), datosfactura AS (SELECT idDatosFactura, idDatosFactura % 2 AS manual
    FROM (SELECT DISTINCT lote AS idDatosFactura FROM factura)
), users AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS first_name,
    c_name AS last_name FROM customer
), tipoPago AS (SELECT id, 'TIPO ' || CAST(id AS VARCHAR) AS tipoPago
    FROM (SELECT DISTINCT o_orderkey % 3 + 1 AS id FROM orders)
), factura_siat AS (SELECT o_orderkey AS factura_id, o_orderkey % 3 AS codigoSucursal,
    o_orderkey % 2 AS codigoPuntoVenta, 'R' || CAST(o_orderkey AS VARCHAR) AS codigoRecepcion,
    {S.code('o_orderkey')} AS cuf,
    CASE WHEN o_orderkey % 7 = 0 THEN 'CAFC' || CAST(o_orderkey AS VARCHAR) END AS cafc,
    o_orderpriority AS pedido, 'Ley ' || CAST(o_orderkey % 10 AS VARCHAR) AS leyenda,
    o_orderdate AS fechaEmision, o_orderkey % 2 + 1 AS codigoMetodoPago FROM orders
), clientes AS (SELECT c_custkey AS idCliente, lower(replace(c_name, '#', '.')) || '@correo.bo' AS email FROM customer
), siat_sincro_tipo_metodo_pago AS (SELECT codigoClasificador, 'METODO ' || CAST(codigoClasificador AS VARCHAR)
    AS descripcion FROM (SELECT DISTINCT o_orderkey % 2 + 1 AS codigoClasificador FROM orders)
), siat_cuis AS (SELECT DISTINCT o_orderkey % 3 AS sucursal, o_orderkey % 2 AS codigoPuntoVenta, 1 AS active FROM orders
    UNION ALL SELECT DISTINCT o_orderkey % 3, o_orderkey % 2, 0 FROM orders
), almacenes AS (SELECT idalmacen, 'ALMACEN ' || CAST(idalmacen AS VARCHAR) AS almacen
    FROM (SELECT DISTINCT o_orderkey % 4 AS idalmacen FROM orders)
)"""


def extract_sql(start: str, end: str, lot_floor: int = 138) -> str:
    """The ledger extract over the CTEs above, from its rule: an invoice of
    the period and lots takes its smallest usable detail (one whose movement
    and seller exist) and its smallest payment, if any, and one row of each
    dimension; invoices that lack a dimension are left out."""
    return f"""WITH wanted AS (
    SELECT * FROM factura WHERE fechaFac >= DATE '{start}' AND fechaFac <= DATE '{end}' AND (lote = 0 OR lote >= {lot_floor})
  ), person AS (SELECT id, first_name || ' ' || last_name AS whole_name FROM users
  ), detail AS (
    SELECT idFactura, min(idegresos) AS idegresos FROM factura_egresos
    WHERE idegresos IN (SELECT idegresos FROM egresos
                        WHERE tipomov IN (SELECT id FROM tmovimiento) AND vendedor IN (SELECT id FROM person))
    GROUP BY idFactura
  ), sold AS (
    SELECT detail.idFactura, sigla, whole_name AS vendedor, clientePedido AS pedido_cliente
    FROM detail JOIN egresos USING (idegresos) JOIN tmovimiento ON tmovimiento.id = tipomov JOIN person ON person.id = vendedor
  ), paid AS (
    SELECT idFactura, min(idPago) AS idPago, min_by(numPago, idPago) AS numPago
    FROM pago_factura JOIN pago USING (idPago) GROUP BY idFactura
  ), reported AS (
    SELECT factura_siat.*, descripcion AS metodoPago
    FROM factura_siat
    JOIN siat_sincro_tipo_metodo_pago ON codigoClasificador = codigoMetodoPago
    SEMI JOIN (SELECT sucursal, codigoPuntoVenta AS punto FROM siat_cuis WHERE active = 1) open_point
      ON sucursal = codigoSucursal AND punto = codigoPuntoVenta
  )
  SELECT idFactura, codigoSucursal, codigoPuntoVenta, lote, manual, nFactura AS numeroFactura, fechaFac, ClienteNit,
    email AS emailCliente, ClienteFactura, sigla, total, sold.vendedor, anulada AS estado, fecha, glosa, idPago, numPago,
    pagada, wanted.almacen AS idAlmacen, pedido_cliente, MAP {{1: 'BOB', 2: '$U$'}}[moneda] AS moneda,
    CASE anulada WHEN 1 THEN 'ANULADA' ELSE MAP {{0: 'NO PAGADA', 1: 'PAGADA', 2: 'PAGO PARCIAL'}}[pagada] END AS pagadaF,
    whole_name AS emisor, tipoPago.tipoPago, codigoRecepcion, cuf, cafc, pedido AS pedido_siat, metodoPago, leyenda,
    fechaEmision AS fechaEmisionSiat, almacenes.almacen
  FROM wanted
  JOIN sold USING (idFactura)
  LEFT JOIN paid USING (idFactura)
  JOIN reported ON factura_id = idFactura
  JOIN clientes ON idCliente = cliente
  JOIN person ON person.id = autor
  JOIN tipoPago ON tipoPago.id = wanted.tipoPago
  JOIN almacenes ON idalmacen = wanted.almacen
  JOIN datosfactura ON idDatosFactura = lote"""
