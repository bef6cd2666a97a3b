"""Fixed values that must equal the reference's for equal results.

Column orders here define vector layouts (encoders, profiles), so they are kept exactly as
the reference lists them.
"""

# ---- fixed values: event type names -------------------------------------------------------
PRODUCT_BUY = "product_buy"
ADD_TO_CART = "add_to_cart"
REMOVE_FROM_CART = "remove_from_cart"
PAGE_VISIT = "page_visit"
SEARCH_QUERY = "search_query"
PRODUCT_TYPES = [PRODUCT_BUY, ADD_TO_CART, REMOVE_FROM_CART]

# ---- fixed values: profile (aggregate baseline) layout ------------------------------------
# per event type, the columns that get windowed statistics, in profile order
EVENT_TYPE_TO_COLUMNS = {
    PRODUCT_BUY: ["sku", "category", "price"],
    ADD_TO_CART: ["sku", "category", "price"],
    REMOVE_FROM_CART: ["sku", "category", "price"],
    PAGE_VISIT: ["url"],
    SEARCH_QUERY: [],
}
PROFILE_NUM_DAYS = [1, 7, 30]
PROFILE_TOP_N = 10

# ---- fixed values: feature pipeline parameters ---------------------------------------------
SESSION_THRESHOLD_S = 40 * 60
ASOF_TOLERANCE_S = 5 * 60
TOP_ITEMS = 150
N_CLUSTERS = 100
KMEANS_SEED = 42
ENTROPY_EPS = 1e-9
ENTROPY_P_CAP = 0.999999
DECAY_ALPHA = 0.06
ENCODED_WIDTH = 59
PAD_VALUE = -1.0
DAYS_IN_TARGET = 14
MAX_EMBEDDING_DIM = 2048
FLOAT16_MAX = 65504.0
MAX_EPOCH = 3
BLEND_ALPHA_OLD = 0.3
FINAL_PROFILE_WIDTH = 744
METRIC_EPS = 10e-10
NOVELTY_K = 10
NOVELTY_POWER = 100
CAP_WEEKLY_MAX = 600
MULTITASK_WEIGHTS = {"churn": 0.3, "category": 0.35, "sku": 0.35}
PROPENSITY_WEIGHTS = {"auroc": 0.8, "diversity": 0.1, "novelty": 0.1}
DEFAULT_FUTURE_WEIGHT = 0.8

# ---- fixed values: scaling groups per event kind --------------------------------------------
# counts: yeo (or minmax) then [-1, 1]
PRODUCT_COUNT_COLUMNS = [
    "count_add", "count_buy", "count_remove", "count_user_add", "count_user_buy",
    "count_user_remove", "tot_user_add", "tot_user_buy", "tot_user_remove",
    "cluster_add_count", "cluster_buy_count", "cluster_remove_count",
    "cluster_add_user_count", "cluster_buy_user_count", "cluster_remove_user_count",
    "count_cat_add", "count_cat_buy", "count_cat_remove", "count_cat_user_add",
    "count_cat_user_buy", "count_cat_user_remove",
]
# plain min-max to [-1, 1]
PRODUCT_CR_COLUMNS = ["global_cat_cr", "local_cat_cr", "global_cr", "local_cr", "cr", "price"]
# log1p then [-1, 1]
PRODUCT_ENTROPY_COLUMNS = ["sku_entropy", "user_sku_entropy", "cat_entropy",
                           "user_cat_entropy", "cluster_entropy", "user_cluster_entropy"]
QUERY_ENTROPY_COLUMNS = ["query_entropy", "cluster_entropy", "user_query_entropy",
                         "user_cluster_entropy"]
QUERY_COUNT_COLUMNS = ["num_events_nearby", "query_score", "query_user_score",
                       "queries_made_by_user", "cluster_made_by_user", "cluster_score"]
URL_ENTROPY_COLUMNS = ["url_entropy", "client_entropy"]
URL_COUNT_COLUMNS = ["count", "client_total_visits", "client_url_visits", "num_events_nearby"]

# ---- fixed values: event encoder payloads -----------------------------------------------------
TIME_FIELDS = ["hour_norm", "weekday_norm", "week_of_month_norm"]
PRODUCT_SCALARS = [
    "count_user_buy", "count_user_add", "count_user_remove",
    "user_sku_entropy", "user_cluster_entropy", "user_cat_entropy",
    "cr", "local_cr", "global_cr",
    "tot_user_buy", "tot_user_add", "tot_user_remove",
    "top_sku",
    "cluster_buy_user_count", "cluster_add_user_count", "cluster_remove_user_count",
    "cluster_buy_count", "cluster_add_count", "cluster_remove_count",
    "cluster_entropy", "sku_entropy",
    "count_buy", "count_add", "count_remove", "top_category",
    "count_cat_user_buy", "count_cat_user_add", "count_cat_user_remove",
    "global_cat_cr", "local_cat_cr",
    "count_cat_buy", "count_cat_add", "count_cat_remove",
    "cat_entropy",
    "price",
]
VISIT_SCALARS = ["client_url_visits", "client_total_visits", "url_entropy", "count",
                 "has_top_sku", "has_top_category", "num_events_nearby", "time_diff"]
SEARCH_SCALARS = [
    "query_user_score", "queries_made_by_user", "user_query_entropy", "user_cluster_entropy",
    "query_score", "cluster_score", "cluster_made_by_user",
    "query_entropy", "cluster_entropy",
    "has_top_sku", "has_top_category",
    "num_events_nearby",
    "time_diff",
]
# one-hot slot order of the event type
ONEHOT_ORDER = [PRODUCT_BUY, ADD_TO_CART, REMOVE_FROM_CART, PAGE_VISIT]

# ---- fixed values: validator messages -----------------------------------------------------------
MSG_IDS_DTYPE = "client_ids dtype is {dtype} – should be int64"
MSG_IDS_NOT_PERMUTATION = "client ids are not a permutation of relevant clients"
MSG_EMB_DIM = "maximum embeddings dimensionality i.e. {limit} has been exceeded"
MSG_EMB_DTYPE = "embeddings dtype should be float16 instead got {dtype}"
MSG_EMB_NAN = "embeddings should not contain nans"
MSG_EMB_INF = "embeddings should not contain infs"
MSG_LENGTH = "client ids and embeddings have different lengths"
