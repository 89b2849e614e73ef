"""What users import."""

from .functions.scalar import analyze_date, dice_similarity, infer_cell_type, is_blank, normalize_whitespace, numeric_string, parse_boolean, parse_number, reformat_date
from .operators.cells import cells, profile_frame, profiles
from .operators.clean import clean_table
from .operators.columns import detect_format, detect_outliers
from .operators.duplicates import detect_duplicates, exact_groups, near_duplicates
from .operators.integrity import detect_integrity
from .operators.report import localize, render_changes, render_html, render_report, render_rules
from .plans.engine import analyze_csv, analyze_table, clean_and_report, summarize
from .plans.model import BalanceCheck, CleanOptions, Duplicates, Integrity, Issue, Near, Options, Outliers, Profile, Range, ReferentialCheck, Report, SumCheck, Table
from .sources.tables import cleaned_name, from_dataframe, parse_csv, read_csv, table_from_rows, to_csv, write_csv
from .sources.xlsx import is_xlsx_filename, parse_xlsx, read_xlsx
from .streaming.tables import report_batches, running_counts

__all__ = [n for n in dir() if not n.startswith("_")]
