from tillpulse.plans.dashboard import (
    TILES,
    as_hour_map,
    fill_hours,
    hourly_compare,
    hourly_document,
    hourly_from_totals,
    kpi_document,
    kpi_tiles,
)
from tillpulse.plans.search import (
    age_facet,
    age_terms,
    gender_facet,
    gender_terms,
    sale_page,
    sale_search,
    sale_search_document,
    total_hits,
)

__all__ = [
    "TILES",
    "age_facet", "age_terms", "as_hour_map", "fill_hours", "gender_facet", "gender_terms", "hourly_compare",
    "hourly_document", "hourly_from_totals", "kpi_document", "kpi_tiles", "sale_page", "sale_search", "sale_search_document", "total_hits",
]
