"""Declared schemas of the tables the library reads and writes."""

# Column names and types of the recorded files.
OPTIONAL_NEGATIVES = ("title string, text string, PMID string, MESH_terms string, "
                      "doi string, source string, labels int")
PREDICTIONS = "label int, prediction int, score double, fold int, title string"

METRIC_COLUMNS = ["f1", "recall", "precision", "accuracy", "roc_auc", "AP", "MCC", "NDCG", "kappa",
                  "TN", "FP", "FN", "TP"]
METRICS = ("model_name string, loss_type string, fold int, run int, with_title boolean, with_keywords boolean, "
           "nb_added_negs int, f1 double, recall double, precision double, accuracy double, roc_auc double, "
           "AP double, MCC double, NDCG double, kappa double, TN bigint, FP bigint, FN bigint, TP bigint, "
           "num_trials int, hpo_metric string")

# One article of a citation export; text content of an element arrives as a string.
ARTICLE_XML = (
    "MedlineCitation struct<PMID:string,"
    "Article:struct<ArticleTitle:string,Abstract:struct<AbstractText:array<string>>,"
    "ELocationID:array<struct<_VALUE:string,_EIdType:string>>>,"
    "MeshHeadingList:struct<MeshHeading:array<struct<DescriptorName:string>>>>")
