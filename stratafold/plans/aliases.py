"""Views over the layer tables under the table and column names that existing
reports use, so their SQL runs unchanged."""

from __future__ import annotations

from stratafold.schemas import TABLES
from stratafold.sources.layers import Layers

# Names that existing reports ask for.
VIEW_NAMES = {
    "gold.top_customers_30d": "gold.top_clientes_30d",
    "gold.response_time": "gold.tempo_resposta_ticket",
    "gold.cohort_retention": "gold.retencao_coorte",
}
COLUMN_NAMES = {
    "total_events": "total_eventos",
    "month": "mes",
    "avg_response_minutes": "avg_minutos_resposta",
    "answered_tickets": "tickets_com_resposta",
    "unanswered_tickets": "tickets_sem_resposta",
    "cohort_customers": "clientes_na_coorte",
    "active_customers": "clientes_ativos",
    "retention_pct": "retencao_pct",
}


def create_views(layers: Layers) -> list[str]:
    """Create or replace the views of the marts; returns their names."""
    for table, view in VIEW_NAMES.items():
        layers.create(table)
        columns = ", ".join(f"`{c}` AS `{COLUMN_NAMES.get(c, c)}`" for c in TABLES[table][0].fieldNames())
        layers.spark.sql(
            f"CREATE OR REPLACE VIEW {layers.name(view)} AS SELECT {columns} FROM {layers.name(table)}"
        )
    return list(VIEW_NAMES.values())
