"""Run configuration: column roles, thresholds and fixed domain values.

Operators never hard-code a column name; they read it from one of the
frozen dataclasses below, so the same code runs on the real register
headers and on the derived test views.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# ---------------------------------------------------------------------------
# Fixed values that must equal the reconciled system's conventions.
# ---------------------------------------------------------------------------

# Spanish month names, January to December (period resolver).
MONTH_NAMES = (
    "ENERO", "FEBRERO", "MARZO", "ABRIL", "MAYO", "JUNIO",
    "JULIO", "AGOSTO", "SEPTIEMBRE", "OCTUBRE", "NOVIEMBRE", "DICIEMBRE",
)

# Branch code -> display name used in the branch report.
BRANCH_NAMES = {"0": "CENTRAL", "5": "SANTA CRUZ", "6": "POTOSI"}

# Authorization-code layout: the first 42 hex characters are read as one
# integer, its decimal form loses its first 27 digits, and the remaining
# (at least 24) digits hold these fields at fixed [start, end) offsets.
CODE_HEX_CHARS = 42
CODE_DROP_DIGITS = 27
CODE_MIN_TAIL = 24
CODE_FIELDS = (
    ("SUCURSAL", 0, 4),
    ("MODALIDAD", 4, 5),
    ("TIPO EMISION", 5, 6),
    ("TIPO FACTURA", 6, 7),
    ("SECTOR", 7, 9),
    ("NUM FACTURA", 9, 19),
    ("PV", 19, 23),
    ("CODIGO AUTOVERIFICADOR", 23, 24),
)

# Observation texts written to the accounting register.
OBS_RENTAL = "Factura de alquiler"
OBS_DOLLAR = "Factura en dólares - SIAT desktop"
OBS_NOT_IN_LEDGER = "No existe en inventarios"

# Author stamped on rows loaded by this engine (its own name).
DEFAULT_AUTHOR = "concilia"

# Tax-register header -> accounting-register column (source names as
# published by the tax authority export; target names of the register).
REGISTER_COLUMN_MAP = (
    ("FECHA DE LA FACTURA", "invoice_date"),
    ("CODIGO DE AUTORIZACIÓN", "authorization_code"),
    ("NIT / CI CLIENTE", "customer_nit"),
    ("COMPLEMENTO", "complement"),
    ("NOMBRE O RAZON SOCIAL", "customer_name"),
    ("IMPORTE TOTAL DE LA VENTA", "total_sale_amount"),
    ("IMPORTE ICE", "ice_amount"),
    ("IMPORTE IEHD", "iehd_amount"),
    ("IMPORTE IPJ", "ipj_amount"),
    ("TASAS", "fees"),
    ("OTROS NO SUJETOS AL IVA", "other_non_vat_items"),
    ("EXPORTACIONES Y OPERACIONES EXENTAS", "exports_exempt_operations"),
    ("VENTAS GRAVADAS A TASA CERO", "zero_rate_taxed_sales"),
    ("SUBTOTAL", "subtotal"),
    ("DESCUENTOS BONIFICACIONES Y REBAJAS SUJETAS AL IVA", "discounts_bonuses_rebates_subject_to_vat"),
    ("IMPORTE GIFT CARD", "gift_card_amount"),
    ("IMPORTE BASE PARA DEBITO FISCAL", "debit_tax_base_amount"),
    ("DEBITO FISCAL", "debit_tax"),
    ("ESTADO", "status"),
    ("CODIGO DE CONTROL", "control_code"),
    ("TIPO DE VENTA", "sale_type"),
    ("ESTADO CONSOLIDACION", "consolidation_status"),
    ("NUM FACTURA", "invoice_number"),
    ("SUCURSAL", "branch_office"),
    ("MODALIDAD", "modality"),
    ("TIPO EMISION", "emission_type"),
    ("TIPO FACTURA", "invoice_type"),
    ("SECTOR", "sector"),
)

DECIMAL_TARGETS = (
    "total_sale_amount", "ice_amount", "iehd_amount", "ipj_amount",
    "fees", "other_non_vat_items", "exports_exempt_operations",
    "zero_rate_taxed_sales", "subtotal",
    "discounts_bonuses_rebates_subject_to_vat", "gift_card_amount",
    "debit_tax_base_amount", "debit_tax",
)

# Columns written by the keyed upsert, in order.
UPSERT_COLUMNS = (
    "invoice_date", "invoice_number", "authorization_code",
    "customer_nit", "complement", "customer_name",
    *DECIMAL_TARGETS,
    "status", "control_code", "sale_type", "right_to_tax_credit",
    "consolidation_status", "branch_office", "modality", "emission_type",
    "invoice_type", "sector", "author", "observations",
)
# Columns an update leaves untouched (key and original author).
UPSERT_KEEP = ("authorization_code", "author")

# Required, not-null target fields and length limits (validation rules).
REQUIRED_TARGETS = (
    "invoice_date", "invoice_number", "authorization_code",
    "customer_nit", "customer_name", "total_sale_amount",
)
LENGTH_LIMITS = (
    ("authorization_code", 64),
    ("customer_nit", 15),
    ("customer_name", 240),
    ("invoice_number", 15),
)

# Ledger extract: lots kept are 0 or at least this number.
LOT_FLOOR = 138


@dataclass(frozen=True)
class TaxColumns:
    """Column roles in the tax register (defaults = export headers)."""

    key: str = "CODIGO DE AUTORIZACIÓN"
    amount: str = "IMPORTE TOTAL DE LA VENTA"
    nit: str = "NIT / CI CLIENTE"
    status: str = "ESTADO"
    modality: str = "MODALIDAD"
    sector: str = "SECTOR"
    branch: str = "SUCURSAL"
    invoice: str = "NUM FACTURA"


@dataclass(frozen=True)
class LedgerColumns:
    """Column roles in the inventory ledger extract."""

    key: str = "cuf"
    amount: str = "total"
    nit: str = "ClienteNit"
    branch: str = "codigoSucursal"
    invoice: str = "numeroFactura"
    glosa: str = "glosa"
    # total order used where the source relied on row order (newest first)
    order: tuple = ("fechaFac", "numeroFactura", "idFactura")
    # the ledger status column is not a tax status: no cancel filter there
    status: str | None = None


@dataclass(frozen=True)
class ReconConfig:
    tax: TaxColumns = field(default_factory=TaxColumns)
    ledger: LedgerColumns = field(default_factory=LedgerColumns)
    amount_tolerance: float = 0.01
    threshold_pct: float = 0.5
    modality: str | None = "2"
    excluded_sector: str | None = "02"
    minor_issue_limit: int = 5
    valid_status: str = "VALIDA"
    branch_names: tuple = tuple(sorted(BRANCH_NAMES.items()))

    def with_(self, **kw) -> "ReconConfig":
        return replace(self, **kw)
