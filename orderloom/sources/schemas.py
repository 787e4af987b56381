"""Schemas and constraints of the commerce tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# Columns, types and NOT NULL marks of each table. Text lengths
# and NOT NULL are not enforced on read; see operators/constraints.py.
_TABLES = {
    "users": """
        id BIGINT NOT NULL, email VARCHAR(255) NOT NULL, password VARCHAR(255) NOT NULL,
        name VARCHAR(100) NOT NULL, phone VARCHAR(20), birth_date DATE, gender VARCHAR(10),
        status VARCHAR(20), tier VARCHAR(20), registration_date TIMESTAMP_NTZ,
        last_login TIMESTAMP_NTZ, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ""",
    "user_addresses": """
        id BIGINT NOT NULL, user_id BIGINT NOT NULL, address_type VARCHAR(20) NOT NULL,
        postal_code VARCHAR(20), address1 VARCHAR(255) NOT NULL, address2 VARCHAR(255),
        city VARCHAR(100) NOT NULL, state VARCHAR(100), country VARCHAR(100), is_default BOOLEAN,
        created_at TIMESTAMP_NTZ""",
    "user_preferences": """
        id BIGINT NOT NULL, user_id BIGINT NOT NULL, preferred_categories ARRAY<STRING>,
        preferred_brands ARRAY<STRING>, price_range_min DECIMAL(10,2), price_range_max DECIMAL(10,2),
        notification_email BOOLEAN, notification_sms BOOLEAN, notification_push BOOLEAN,
        created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ""",
    "categories": """
        id BIGINT NOT NULL, name VARCHAR(100) NOT NULL, parent_id BIGINT, description STRING,
        level INT, sort_order INT, is_active BOOLEAN, created_at TIMESTAMP_NTZ""",
    "brands": """
        id BIGINT NOT NULL, name VARCHAR(100) NOT NULL, description STRING, website VARCHAR(255),
        country VARCHAR(100), established_year INT, is_premium BOOLEAN, created_at TIMESTAMP_NTZ""",
    "products": """
        id BIGINT NOT NULL, sku VARCHAR(50) NOT NULL, name VARCHAR(255) NOT NULL, description STRING,
        short_description VARCHAR(500), category_id BIGINT NOT NULL, brand_id BIGINT,
        price DECIMAL(10,2) NOT NULL, compare_at_price DECIMAL(10,2), cost_price DECIMAL(10,2),
        weight DECIMAL(10,2), dimensions VARCHAR(100), material VARCHAR(100), color VARCHAR(50),
        size VARCHAR(50), status VARCHAR(20), is_featured BOOLEAN, is_digital BOOLEAN,
        stock_quantity INT, low_stock_threshold INT, meta_title VARCHAR(255), meta_description STRING,
        tags ARRAY<STRING>, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ""",
    "product_images": """
        id BIGINT NOT NULL, product_id BIGINT NOT NULL, image_url VARCHAR(500) NOT NULL,
        alt_text VARCHAR(255), sort_order INT, is_primary BOOLEAN, created_at TIMESTAMP_NTZ""",
    "product_reviews": """
        id BIGINT NOT NULL, product_id BIGINT NOT NULL, user_id BIGINT NOT NULL, rating INT NOT NULL,
        title VARCHAR(255), content STRING, pros ARRAY<STRING>, cons ARRAY<STRING>,
        is_verified_purchase BOOLEAN, helpful_count INT, status VARCHAR(20),
        created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ""",
    "inventory_logs": """
        id BIGINT NOT NULL, product_id BIGINT NOT NULL, quantity_change INT NOT NULL,
        previous_quantity INT NOT NULL, new_quantity INT NOT NULL, reason VARCHAR(50) NOT NULL,
        reference_id BIGINT, reference_type VARCHAR(50), created_at TIMESTAMP_NTZ""",
    "coupons": """
        id BIGINT NOT NULL, code VARCHAR(50) NOT NULL, name VARCHAR(255) NOT NULL, description STRING,
        discount_type VARCHAR(20) NOT NULL, discount_value DECIMAL(10,2) NOT NULL,
        minimum_purchase DECIMAL(10,2), maximum_discount DECIMAL(10,2), usage_limit INT, usage_count INT,
        user_usage_limit INT, applicable_categories ARRAY<INT>, applicable_products ARRAY<INT>,
        start_date TIMESTAMP_NTZ NOT NULL, end_date TIMESTAMP_NTZ NOT NULL, is_active BOOLEAN,
        created_at TIMESTAMP_NTZ""",
    "orders": """
        id BIGINT NOT NULL, order_number VARCHAR(50) NOT NULL, user_id BIGINT, guest_email VARCHAR(255),
        status VARCHAR(20), payment_status VARCHAR(20), shipping_status VARCHAR(20),
        subtotal DECIMAL(10,2) NOT NULL, discount_amount DECIMAL(10,2), tax_amount DECIMAL(10,2),
        shipping_amount DECIMAL(10,2), total_amount DECIMAL(10,2) NOT NULL, currency VARCHAR(3),
        coupon_id BIGINT, coupon_code VARCHAR(50), notes STRING, internal_notes STRING,
        shipping_address_id BIGINT, billing_address_id BIGINT, ip_address VARCHAR(45),
        user_agent STRING, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ""",
    "order_items": """
        id BIGINT NOT NULL, order_id BIGINT NOT NULL, product_id BIGINT NOT NULL,
        product_name VARCHAR(255) NOT NULL, product_sku VARCHAR(50), quantity INT NOT NULL,
        unit_price DECIMAL(10,2) NOT NULL, discount_amount DECIMAL(10,2),
        total_price DECIMAL(10,2) NOT NULL, created_at TIMESTAMP_NTZ""",
    "payments": """
        id BIGINT NOT NULL, order_id BIGINT NOT NULL, payment_method VARCHAR(50) NOT NULL,
        payment_gateway VARCHAR(50), transaction_id VARCHAR(255), amount DECIMAL(10,2) NOT NULL,
        currency VARCHAR(3), status VARCHAR(20), failure_reason STRING, payment_date TIMESTAMP_NTZ,
        created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ""",
    "shipments": """
        id BIGINT NOT NULL, order_id BIGINT NOT NULL, tracking_number VARCHAR(100), carrier VARCHAR(50),
        shipping_method VARCHAR(50), estimated_delivery_date DATE, actual_delivery_date DATE,
        shipping_address STRING NOT NULL, status VARCHAR(20), notes STRING,
        created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ""",
    "shipment_tracking": """
        id BIGINT NOT NULL, shipment_id BIGINT NOT NULL, status VARCHAR(50) NOT NULL,
        location VARCHAR(255), description STRING, timestamp TIMESTAMP_NTZ""",
    "cart_items": """
        id BIGINT NOT NULL, user_id BIGINT, session_id VARCHAR(255), product_id BIGINT NOT NULL,
        quantity INT NOT NULL, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ""",
    "wishlist_items": """
        id BIGINT NOT NULL, user_id BIGINT NOT NULL, product_id BIGINT NOT NULL,
        created_at TIMESTAMP_NTZ""",
    "product_views": """
        id BIGINT NOT NULL, product_id BIGINT NOT NULL, user_id BIGINT, session_id VARCHAR(255),
        view_duration INT, created_at TIMESTAMP_NTZ""",
    "search_logs": """
        id BIGINT NOT NULL, user_id BIGINT, session_id VARCHAR(255), search_query VARCHAR(255) NOT NULL,
        results_count INT, clicked_product_id BIGINT, created_at TIMESTAMP_NTZ""",
    "query_baseline": """
        query_id BIGINT, query_hash STRING, query_sample STRING, baseline_mean_time DOUBLE,
        baseline_calls INT, baseline_total_time DOUBLE, recorded_at TIMESTAMP_NTZ""",
    "catalogue": """
        id STRING NOT NULL, name STRING, description STRING, price DECIMAL(18,2), stock INT,
        category STRING, created_at TIMESTAMP_NTZ""",
    "request_orders": """
        id BIGINT, user_id BIGINT NOT NULL, product_id BIGINT NOT NULL, quantity INT NOT NULL,
        status VARCHAR(50) NOT NULL, total_amount DECIMAL(10,2) NOT NULL, created_at TIMESTAMP_NTZ,
        updated_at TIMESTAMP_NTZ""",
}


@dataclass(frozen=True)
class Reference:
    """A column that refers to the id of another table; ``on_delete`` is restrict, cascade or null."""

    column: str
    parent: str
    on_delete: str = "restrict"


@dataclass(frozen=True)
class Constraints:
    unique: tuple[tuple[str, ...], ...] = ()
    ranges: tuple[tuple[str, int, int], ...] = ()
    references: tuple[Reference, ...] = ()
    defaults: dict[str, object] = field(default_factory=dict)


def _owned(column: str, parent: str) -> Reference:
    return Reference(column, parent, "cascade")


# Keys, ranges, references and defaults.
CONSTRAINTS = {
    "users": Constraints(unique=(("email",),), defaults={"status": "ACTIVE", "tier": "BRONZE"}),
    "user_addresses": Constraints(
        references=(_owned("user_id", "users"),), defaults={"country": "Korea", "is_default": False}
    ),
    "user_preferences": Constraints(
        references=(_owned("user_id", "users"),),
        defaults={"notification_email": True, "notification_sms": False, "notification_push": True},
    ),
    "categories": Constraints(
        references=(Reference("parent_id", "categories"),),
        defaults={"level": 1, "sort_order": 0, "is_active": True},
    ),
    "brands": Constraints(defaults={"is_premium": False}),
    "products": Constraints(
        unique=(("sku",),),
        references=(Reference("category_id", "categories"), Reference("brand_id", "brands")),
        defaults={
            "status": "ACTIVE",
            "is_featured": False,
            "is_digital": False,
            "stock_quantity": 0,
            "low_stock_threshold": 10,
        },
    ),
    "product_images": Constraints(
        references=(_owned("product_id", "products"),), defaults={"sort_order": 0, "is_primary": False}
    ),
    "product_reviews": Constraints(
        ranges=(("rating", 1, 5),),
        references=(_owned("product_id", "products"), _owned("user_id", "users")),
        defaults={"is_verified_purchase": False, "helpful_count": 0, "status": "APPROVED"},
    ),
    "inventory_logs": Constraints(references=(Reference("product_id", "products"),)),
    "coupons": Constraints(
        unique=(("code",),),
        defaults={"minimum_purchase": 0, "usage_count": 0, "user_usage_limit": 1, "is_active": True},
    ),
    "orders": Constraints(
        unique=(("order_number",),),
        references=(
            Reference("user_id", "users"),
            Reference("coupon_id", "coupons"),
            Reference("shipping_address_id", "user_addresses"),
            Reference("billing_address_id", "user_addresses"),
        ),
        defaults={
            "status": "PENDING",
            "payment_status": "PENDING",
            "shipping_status": "PENDING",
            "discount_amount": 0,
            "tax_amount": 0,
            "shipping_amount": 0,
            "currency": "KRW",
        },
    ),
    "order_items": Constraints(
        references=(_owned("order_id", "orders"), Reference("product_id", "products")),
        defaults={"discount_amount": 0},
    ),
    "payments": Constraints(
        references=(Reference("order_id", "orders"),), defaults={"currency": "KRW", "status": "PENDING"}
    ),
    "shipments": Constraints(
        references=(Reference("order_id", "orders"),), defaults={"status": "PROCESSING"}
    ),
    "shipment_tracking": Constraints(references=(_owned("shipment_id", "shipments"),)),
    "cart_items": Constraints(
        references=(_owned("user_id", "users"), Reference("product_id", "products")),
        defaults={"quantity": 1},
    ),
    "wishlist_items": Constraints(
        unique=(("user_id", "product_id"),),
        references=(_owned("user_id", "users"), _owned("product_id", "products")),
    ),
    "product_views": Constraints(
        references=(_owned("product_id", "products"), Reference("user_id", "users", "null"))
    ),
    "search_logs": Constraints(
        references=(Reference("user_id", "users", "null"),), defaults={"results_count": 0}
    ),
}


def table_names() -> list[str]:
    return list(_TABLES)


def declared_schema(table: str) -> T.StructType:
    """The schema with text lengths and NOT NULL as declared."""
    return T.StructType.fromDDL(_TABLES[table])


def table_schema(table: str) -> T.StructType:
    """The schema to read with: plain text columns, everything nullable."""
    return T.StructType(
        [
            T.StructField(
                f.name, T.StringType() if isinstance(f.dataType, T.VarcharType) else f.dataType, True
            )
            for f in declared_schema(table).fields
        ]
    )


def required_columns(table: str) -> list[str]:
    return [f.name for f in declared_schema(table).fields if not f.nullable]


#: Columns that default to the current time, in every table with constraints that has them.
_STAMPED = ("registration_date", "created_at", "updated_at", "timestamp")


def declared_defaults(table: str, as_of: object) -> dict[str, object]:
    """Defaults of a table's columns; ``as_of`` stands for the current time."""
    stamped = [c for c in _STAMPED if table in CONSTRAINTS and c in declared_schema(table).fieldNames()]
    return {**CONSTRAINTS.get(table, Constraints()).defaults, **dict.fromkeys(stamped, as_of)}


def length_limits(table: str) -> dict[str, int]:
    return {
        f.name: f.dataType.length
        for f in declared_schema(table).fields
        if isinstance(f.dataType, T.VarcharType)
    }


def children_of(parent: str) -> list[tuple[str, Reference]]:
    """Tables and columns that refer to a table."""
    return [
        (table, reference)
        for table, constraints in CONSTRAINTS.items()
        for reference in constraints.references
        if reference.parent == parent
    ]
