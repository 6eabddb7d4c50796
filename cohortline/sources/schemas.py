"""Input schemas by source. Columns that need repair are read as text."""

from __future__ import annotations

from pyspark.sql import types as T

TEXT, WHOLE, NUMBER, DATE = T.StringType(), T.LongType(), T.DoubleType(), T.DateType()


def schema(**fields: T.DataType) -> T.StructType:
    """Fields in order, by name and type."""
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


CLINVAR = schema(
    assembly=TEXT, name=TEXT, clinical_significance=TEXT, origin_simple=TEXT, phenotype_list=TEXT
)
POPULATION_FREQUENCY = schema(
    gene=TEXT, s_nom=TEXT, p_nom=TEXT, rs_id=TEXT, chromosome=TEXT, position=WHOLE, reference=TEXT,
    alternate=TEXT, consequence=TEXT, annotation=TEXT, allele_frequency=NUMBER,
)
SOMATIC_CATALOGUE = schema(gene_name=TEXT, mutation_cds=TEXT)
GENE_LISTS = schema(
    germline_blood=TEXT, inheritance_blood=TEXT, ch_ip_nejm=TEXT, ch_ip_nat_med=TEXT,
    somatic_blood=TEXT,
)
PANEL_CALLS = schema(
    patient=TEXT, mrn=WHOLE, dob=DATE, request_date=TEXT, gene=TEXT, c_nom=TEXT, p_nom=TEXT, af=TEXT
)
VALIDATION = schema(
    mrn=WHOLE, gene=TEXT, s_nom=TEXT, p_nom=TEXT, grade=WHOLE, consented_to_research=TEXT,
    etiology=TEXT, path_level=TEXT, varsome=TEXT, confirmation_date=TEXT, id=WHOLE, count=WHOLE,
    variance=NUMBER, clin_var=TEXT,
)
BROAD_CALLS = schema(
    sample=TEXT, date=TEXT, gene=TEXT, g_nomen=TEXT, c_nomen=TEXT, p_nomen=TEXT, af=TEXT,
    clin_var_clin_signifs=TEXT, coding_effect=TEXT, gnomad_alt_freq_all=NUMBER,
)
CLINICAL_ORDERS = schema(
    mrn=WHOLE, order=TEXT, s=TEXT, dob=TEXT, order_date=TEXT, sequence_date=TEXT, sex=TEXT,
    onco_tree_specimen_site=TEXT, onco_tree_primary_tumor_site=TEXT, onco_tree_diagnosis=TEXT,
    percent_tumor=TEXT,
)
SURVIVAL = schema(patient_name_mrn=TEXT, order_date=TEXT, date_of_birth=TEXT, death_date=TEXT)
REVIEWED = schema(id=WHOLE, gene=TEXT, p_nomen=TEXT, clin_var=TEXT, varsome=TEXT, path_level=TEXT)
GENE_STATUS = schema(s_nom=TEXT, cohort_status=TEXT, p_nom_r=TEXT)
