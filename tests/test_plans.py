"""The studies end to end, from delimited files with known answers."""

import pytest

from cohortline.operators import report
from cohortline.plans import broad, outcome, panel
from cohortline.sources import schemas
from cohortline.sources.delimited import read_delimited


def put(folder, name, text):
    (folder / name).write_text(text)
    return str(folder / name)


@pytest.fixture
def genes(spark, tmp_path):
    path = put(tmp_path, "lists.csv", "Germline_Blood,Inheritance_Blood,ChIP_NEJM,ChIP_NatMed,Somatic_Blood\n"
               "G1,AD,G1,G1,G2\nG3,AR,G2,,\nNA,,,,\n")
    return read_delimited(spark, path, schemas.GENE_LISTS, null_tokens=["", "NA"])


def test_panel_study(spark, tmp_path, genes):
    calls = put(tmp_path, "calls.csv", "X,Patient,MRN,DOB,Request.Date,Gene,C.Nom,P.Nom,AF\n"
                "1,A,1,1960-01-01,01/01/19,G1,NM_1:c.1A&gt;T,p.A1,0.50\n"
                "2,A,1,1960-01-01,01/31/19,G1,NM_1:c.1A&gt;T,p.A1,0.52\n"
                "2,A,1,1960-01-01,01/31/19,G1,NM_1:c.1A&gt;T,p.A1,0.52\n"
                "3,A,1,1960-01-01,01/31/19,G2,NM_2:c.5G&gt;C,999,abc\n"
                "4,B,2,1950-06-01,03/01/20,G2,NM_2:c.5G&gt;C,p.B2,0.10\n"
                "5,B,2,1950-06-01,03/01/22,G2,NM_2:c.5G&gt;C,p.B2,0.11\n")
    clinvar = put(tmp_path, "cv.txt", "Assembly\tName\tClinicalSignificance\tOriginSimple\tPhenotypeList\n"
                  "GRCh37\tNM_1(G1):c.1A>T (p.A1)\tBenign\tgermline\tx\n"
                  "GRCh38\tNM_1(G1):c.1A>T (p.A1)\tPathogenic\tgermline\tx\n")
    freq = put(tmp_path, "f.csv", "Gene,S.Nom,P.Nom,rsID,Chromosome,Position,Reference,Alternate,Consequence,Annotation,Allele.Frequency\n"
               "G2,c.5G>C,p.B2,rs1,1,12,G,C,m,a,0.5\n")
    study = panel.panel_study(
        read_delimited(spark, calls, schemas.PANEL_CALLS, null_tokens=["999"]),
        read_delimited(spark, clinvar, schemas.CLINVAR, sep="\t"),
        read_delimited(spark, freq, schemas.POPULATION_FREQUENCY),
        genes,
    )
    graded = {(r.mrn, r.gene, r.time_point): r for r in study["graded"].collect()}
    assert len(graded) == 4  # the repeated row and the late one are gone
    stable = graded[1, "G1", 30]
    assert stable.name == "NM_1(G1):c.1A>T (p.A1)" and stable.clinical_significance == "Benign"
    assert (stable.grade, stable.n_obs, stable.inheritance_blood) == (1, 2, "AD")
    assert stable.variance == pytest.approx(0.027730, abs=1e-6)
    gap = graded[1, "G2", 30]
    assert gap.name == "NM_2(G2):c.5G>C (NA)" and gap.af == 0.0 and gap.grade == 5
    assert gap.clinical_significance == "not in ClinVar" and gap.inheritance_blood == "Unknown"
    assert gap.allele_frequency == 0.5
    assert graded[1, "G1", 0].age == 21550
    assert {(r.mrn, r.gene, r["count"]) for r in study["recurrent"].collect()} == {(1, "G1", 2)}
    assert study["candidates"].count() == 2
    funnel = {r.stage: r for r in study["funnel"].collect()}
    assert (funnel["all"].patients, funnel["candidates"].patients, funnel["all"].assays) == (2, 1, 3)


@pytest.fixture
def broad_parts(spark, tmp_path, genes):
    head = "SAMPLE\tDATE\tgene\tgNomen\tcNomen\tpNomen\tAF\tclinVarClinSignifs\tcodingEffect\tgnomadAltFreq_all\n"
    one = put(tmp_path, "one.txt", head
              + "CGL1S1T1\t190101\tG1\tg.1\tc.1\tp.1\t0.50\tPathogenic/Likely pathogenic\tmissense\t0.00001\n"
              + "CGL1S1T1\t190103\tG1\tg.1\tc.1\tp.1\t0.90\tPathogenic\tmissense\t0.00001\n"
              + "CGL1S1T1\t190101\tG2\tg.2\tc.2\tp.2\tn/a\t\tmissense\t\n"
              + "CGL1S1T1\t190101\tG3\tg.3\tc.3\tp.3\t0.40\tnot provided\t\t\n")
    two = put(tmp_path, "two.txt", head
              + "CGL1S2T1\t190301\tG1\tg.1\tc.1\tp.1\t0.51\tPathogenic/Likely pathogenic\tmissense\t0.00001\n"
              + "CGL2S1T1\t200101\tG1\tg.1\tc.1\tp.1\t0.30\t\tsynonymous\t\n"
              + "CGL2S1T1\t200101\tG3\tg.3\tc.3\tp.3\t0.30\t\tmissense\n")
    extracts = [
        read_delimited(spark, one, schemas.BROAD_CALLS, sep="\t", ragged=True),
        read_delimited(spark, two, schemas.BROAD_CALLS, sep="\t", ragged=True),
    ]
    clin = put(tmp_path, "clin.csv", "MRN,Order,S.,DOB,Order.Date,Sequence.Date,Sex,OncoTree.Specimen.Site,"
               "OncoTree.Primary.Tumor.Site,OncoTree.Diagnosis,Percent.Tumor\n"
               "11,CGL1-T1, S1,1/2/55,1/1/2019,1/5/19,F,b,Blood/Bone Marrow,AML,50\n"
               "11,CGL1-T1, S1,1/2/55,1/1/2019,1/5/19,F,b,Blood/Bone Marrow,AML,50\n"
               "11,CGL1-T2,S2,1/2/55,3/1/2019,3/5/19,F,b,Lymph,,50\n"
               "22,CGL2-T1,S1,3/4/1915,1/1/2020,1/5/20,M,b,Skin,NA,50\n")
    clinical = [read_delimited(spark, clin, schemas.CLINICAL_ORDERS)]
    return extracts, clinical


def test_broad_study(broad_parts, genes):
    extracts, clinical = broad_parts
    study = broad.broad_study(extracts, clinical, genes)
    rows = {(r["sample"], r.gene): r for r in study["enriched"].collect()}
    assert set(rows) == {("CGL1S1", "G1"), ("CGL1S1", "G3"), ("CGL1S2", "G1"), ("CGL2S1", "G3")}
    first = rows["CGL1S1", "G1"]
    assert (first.af, first.cgl, first.mrn, first.time_point) == (0.5, "CGL1", 11, 0)
    assert (first.significance, first.in_blood, first.chip, first.inheritance_blood) == (
        "Likely pathogenic", True, True, "AD",
    )
    assert (first.grade, first.n_obs, first.number_variants) == (1, 2, 2)
    assert first.age == (first.order_date - first.dob).days and first.dob.year == 1955
    second = rows["CGL1S2", "G1"]
    assert (second.time_point, second.onco_tree_diagnosis) == (59, "Not Designated")
    other = rows["CGL1S1", "G3"]
    assert (other.coding_effect, other.significance, other.variance) == ("non-coding", "Not in ClinVar", 1.0)
    outside = rows["CGL2S1", "G3"]
    assert (outside.in_blood, outside.onco_tree_diagnosis, outside.dob.year) == (False, "Not Designated", 1915)
    assert {(r["sample"], r.gene, r["count"]) for r in study["recurrent"].collect()} == {
        ("CGL1S1", "G1", 2), ("CGL1S2", "G1", 2)
    }
    assert study["candidates"].count() == 2
    funnel = {r.stage: r for r in study["funnel"].collect()}
    assert (funnel["in blood"].samples, funnel["in blood"].genes, funnel["candidates"].genes) == (2, 2, 1)


def test_outcome_study(spark, tmp_path, broad_parts, genes):
    extracts, clinical = broad_parts
    study = broad.broad_study(extracts, clinical, genes)
    path = put(tmp_path, "os.csv", "Patient.Name..MRN.,Order.Date,Date.of.Birth,DeathDate\n"
               "\"Doe, J (11)\",03/01/2019,01/02/1955,\n\"Doe, J (11)\",01/31/2019,01/02/1955,\n"
               "Roe (22),01/01/2020,03/04/1915,02/28/2021\nPoe (33),01/01/2020,01/01/1960,\nnobody,01/01/2020,01/01/1960,\n")
    survival = read_delimited(spark, path, schemas.SURVIVAL)
    result = outcome.outcome_study(
        survival, study["enriched"], study["candidates"], broad.clean_clinical(clinical), months=[12]
    )
    people = {r.mrn: r for r in result["subjects"].collect()}
    assert set(people) == {11, 22}
    assert (people[11].event, people[11].landmark, people[11].exposure_ad) == (False, 35, "Grade_12_AD")
    assert (people[22].event, people[22].landmark, people[22].exposure_ad) == (True, 13, "Grade_345")
    assert people[11].age_months == 66 * 12 + 5 and people[11].in_blood and not people[22].in_blood
    assert people[11].in_pathogenic and people[11].sex == "F"
    assert [(r.exposure_ad, r.survival) for r in result["survival_at"].collect()] == [("Grade_12_AD", 1.0)]
    assert people[11].in_grade == "1 5" and people[11].inheritance == "AD" and people[11].in_gene == ""
    assert people[22].inheritance is None
    assert [(r.in_gene, r.exposure, r.time) for r in result["curve_by_gene"].collect()] == [("", "Grade_12", 35)]
    assert [(r.time, r.cumhaz) for r in result["hazard_by_age"].collect()] == [(66 * 12 + 5, 0.0)]
    assert result["survival_at_age"].count() == 0  # nobody followed to 75 years
    assert {(r.horizon, r.n_risk) for r in result["risk_table_by_age"].collect()} >= {(60 * 12, 1), (70 * 12, 0)}
    assert [(r.in_gene, r.horizon, r.survival) for r in result["survival_at_by_gene"].collect()] == [("", 18, 1.0)]
    assert result["logrank_by_age"].first().events == 0 and result["logrank_by_gene"].count() == 0
    assert {(r.grade, r["count"], r.all_items) for r in result["variants_by_grade"].collect()} == {(1, 1, 2), (5, 1, 2)}
    assert not people[11].carries_pathogenic  # its significance is reduced to Likely pathogenic
    classes = report.gene_class_study(study["candidates"], study["enriched"], genes)
    assert [(r.gene, r["count"]) for r in classes["genes"].collect()] == [("G1", 1)]
    assert classes["germline"].first().all_genes == 1 and classes["chip"].first().all_variants == 1
    assert classes["described"].first().n == 1 and classes["bars_by_class"].count() == 0
    assert outcome.unshared_subjects(result["subjects"], study["candidates"]).count() == 0
    dominant, other = outcome.inheritance_reports(study["candidates"], result["subjects"])
    assert [(r.id, r.gene, r.c_nomen, r.grade) for r in dominant.collect()] == [(1, "G1", "c.1", 1)]
    assert other.count() == 0
    reviewed = put(tmp_path, "rev.csv", "ID,gene,pNomen,ClinVar,varsome,path.level\n1,G1,p.1,x,y,P\n2,G9,p.9,x,y,B\n")
    review = outcome.review_study(
        study["candidates"], result["subjects"], read_delimited(spark, reviewed, schemas.REVIEWED)
    )
    assert {r.mrn: r.path_review for r in review["subjects"].collect()} == {11: "P", 22: ""}
    assert [(r.path_level, r["count"], r.freq) for r in review["levels"].collect()] == [("P", 1, 1)]
    assert [(r.path_review, r.time) for r in review["curve"].collect()] == [("P", 35)]
    assert {(r.path_review, r.horizon, r.n_risk) for r in review["risk_table"].collect()} >= {("P", 24, 1), ("P", 36, 0)}
    assert review["logrank"].count() == 0


def test_hazard_ratios_use_the_unexposed_as_reference(frame):
    rows = [
        (i % 11 + 1, i % 4 != 0, outcome.EXPOSURES[i % 3], True) for i in range(90)
    ] + [(1, True, "Grade_12", False)] * 50
    df = frame(rows, "landmark int, event boolean, exposure_ad string, in_blood boolean")
    table = outcome.hazard_ratios(df).collect()
    assert [(r.level, r.n) for r in table] == [("Grade_12", 90), ("Grade_12_AD", 90)]
    assert all(r.lower < r.hazard_ratio < r.upper for r in table)


def test_single_gene_study(frame):
    data = []
    for mrn in range(12):
        steady = mrn % 2 == 0
        for visit in range(3):
            change = "1" if steady else "2"
            data.append((f"P{mrn}", mrn, "G", f"c.{change}", f"p.{change}", f"m{change}", f"k{change}",
                         0.02 + mrn / 1000 if steady else 0.3 + mrn / 100, 0.4 + visit / 10, visit))
    graded = frame(data, "patient string, mrn int, gene string, s_nom string, p_nom string, mutation string,"
                   " gene_snv string, variance double, af double, request_date int")
    status = frame([("c.1", "p.1", "Germline"), ("c.2", "p.2", "Somatic")], "s_nom string, p_nom_r string, cohort_status string")
    study = outcome.single_gene_study(graded, "G", status)
    assert {(r.cohort_status, r["count"], r.freq) for r in study["counts"].collect()} == {("Germline", 6, 12), ("Somatic", 6, 12)}
    # two groups of six without overlap: H = 12/(12*13) * (21²+57²)/6 - 39
    assert study["kruskal"].first().h == pytest.approx(12 / 156 * (21**2 + 57**2) / 6 - 39)
    assert study["auc"].first().auc > 0.99
    assert study["rows"].filter("abs(max_af - 0.6) > 1e-9").count() == 0
    assert study["box"].count() == 2 and study["metrics"].count() == 12


def test_validation_study(spark, tmp_path, frame):
    head = "MRN,Gene,S.Nom,P.Nom,grade,consented.to.research,etiology,path.level,varsome,confirmation.date,ID,count,variance,ClinVar\n"
    lines = [
        f"{i},G,c.{i},p.{i},{1 if i == 3 else 2},{'No' if i == 9 else 'Yes'},"
        f"{'germline' if i < 3 else 'not tested' if i == 8 else 'somatic'},P,v,1/2/2020,1,2,0.1,x"
        for i in range(10)
    ]
    path = put(tmp_path, "v.csv", head + "\n".join(lines + lines[:1]) + "\n")
    labels = read_delimited(spark, path, schemas.VALIDATION)
    grades = frame(
        [(i, "G", f"c.{i}", g) for i, g in enumerate([1, 2, 5, 4, 4, 5, 5, 3])]
        + [(0, "G", "c.0", 3)],
        "mrn long, gene string, s_nom string, grade int",
    )
    study = outcome.validation_study(labels, grades)
    frame_rows = {r.mrn: r for r in study["frame"].collect()}
    assert set(frame_rows) == set(range(8))
    assert [frame_rows[i].id for i in range(8)] == list(range(1, 9))
    assert [frame_rows[i].cohort_status for i in range(8)] == [1, 1, 1, 0, 0, 0, 0, 0]
    assert frame_rows[0].grade_new == 1
    auc = study["auc"].first()
    assert 0.5 < auc.auc < 1 and auc.lower < auc.auc < auc.upper and (auc.n_pos, auc.n_neg) == (3, 5)
    kinds = {(r.mrn, r.kind) for r in study["confusion"].collect()}
    assert kinds == {(2, "false_negative"), (3, "false_positive")}
    assert [(r.gene, r.path_level, r["count"], r.freq) for r in study["levels_by_gene"].collect()] == [("G", "P", 8, 8)]
    assert study["auc_empirical"].first().auc > 0.5 and study["smooth_curve"].count() == 512
    table = outcome.manuscript_table(study["frame"]).collect()
    assert [r.id for r in table] == list(range(1, 9)) and table[0].asDict().keys() == dict.fromkeys(outcome.MANUSCRIPT_COLUMNS).keys()
    assert sum(r["count"] for r in study["shares"].collect()) == 8 and study["band"].count() == 99
    assert study["ks"].first().ks > 0 and study["metrics"].count() == 5 and study["curve"].count() == 99


def test_three_way_exposure_survives_the_logrank(frame):
    df = frame([(i % 9, i % 2 == 0, outcome.EXPOSURES[i % 3]) for i in range(60)], "landmark int, event boolean, exposure_ad string")
    from cohortline.operators.survival import logrank

    test = logrank(df, "landmark", "event", "exposure_ad", outcome.EXPOSURES).first()
    assert test.df == 2 and 0 < test.p <= 1
