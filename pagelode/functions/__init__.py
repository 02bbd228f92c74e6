"""Column functions by theme, for use in any select or filter."""

from ..operators.facts import annual, fiscal_year, full_year_span
from ..operators.match import emission, verdict
from ..operators.scoring import answer_outcome, cell_status, matches, relative_error, wrong_bucket
from ..operators.search import max_sim, sparse_dot, terms
from ..operators.series import session_of, trailing
from ..operators.stats import three_classes
from ..operators.text import (
    currency_context,
    dollar_marks,
    fill_template,
    first_alias,
    locate_loosely,
    marker_flags,
    name_similarity,
    number_tokens,
    page_reasons,
    plain_line,
    plain_marks,
    question_parts,
    report_name,
    resolve_unit,
    short_amount,
    slug,
    snippet,
    strip_html,
    table_size,
    tolerant_json,
    union_box,
    unit_hints,
    value_variants,
)
from ..operators.units import known_scale, read_number, snap, unit_word
from ..operators.wide import attribute_name, read_as
from ..session import clean_ticker, epoch_us

__all__ = [name for name in dir() if not name.startswith("_")]
