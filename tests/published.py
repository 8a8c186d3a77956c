"""Published result values (fixed values; their input log is not available)."""

STAGES = {"view": 9961, "cart": 6994, "purchase": 3281}
CART_AND_PURCHASE = 2313
VIEWLESS = 34
PURCHASE_WITHOUT_CART = 968

RATES = {
    "view_to_cart": (0.7021383395241442, 70.21),
    "cart_to_purchase_strict": (0.33071203889047757, 33.07),
    "view_to_purchase_overall": (0.3293845999397651, 32.94),
}

# month: users, active in week 1, rate, percent
COHORTS = {
    "2024-01": (3030, 260, 0.0858085808580858, 8.58),
    "2024-02": (2024, 134, 0.06620553359683795, 6.62),
    "2024-03": (1486, 104, 0.06998654104979811, 7.0),
    "2024-04": (1035, 63, 0.06086956521739131, 6.09),
    "2024-05": (734, 59, 0.08038147138964577, 8.04),
    "2024-06": (498, 53, 0.10642570281124498, 10.64),
    "2024-07": (392, 30, 0.07653061224489796, 7.65),
    "2024-08": (235, 19, 0.08085106382978724, 8.09),
    "2024-09": (170, 16, 0.09411764705882353, 9.41),
    "2024-10": (122, 10, 0.08196721311475409, 8.2),
    "2024-11": (75, 5, 0.06666666666666667, 6.67),
    "2024-12": (59, 3, 0.05084745762711865, 5.08),
    "2025-01": (40, 8, 0.2, 20.0),
    "2025-02": (26, 2, 0.07692307692307693, 7.69),
    "2025-03": (21, 0, 0.0, 0.0),
    "2025-04": (18, 4, 0.2222222222222222, 22.22),
    "2025-05": (12, 1, 0.08333333333333333, 8.33),
    "2025-06": (5, 1, 0.2, 20.0),
    "2025-07": (5, 0, 0.0, 0.0),
    "2025-08": (1, 0, 0.0, 0.0),
    "2025-09": (4, 0, 0.0, 0.0),
    "2025-10": (3, 0, 0.0, 0.0),
}
OVERALL_RETENTION_PCT = 7.72

# segment value: cart users, purchased, rate, percent; in published order
GENDERS = {
    "Other": (2442, 794, 0.32514332514332517, 32.51),
    "Female": (2284, 777, 0.3401926444833625, 34.02),
    "Male": (2268, 742, 0.3271604938271605, 32.72),
}
CATEGORIES = {
    "Clothing": (757, 244, 0.32232496697490093, 32.23),
    "Pet Supplies": (741, 245, 0.33063427800269907, 33.06),
    "Electronics": (729, 237, 0.32510288065843623, 32.51),
    "Beauty": (725, 244, 0.33655172413793105, 33.66),
    "Toys": (725, 248, 0.34206896551724136, 34.21),
    "Books": (698, 242, 0.3467048710601719, 34.67),
    "Automotive": (671, 207, 0.30849478390462, 30.85),
    "Groceries": (668, 225, 0.33682634730538924, 33.68),
    "Home & Kitchen": (665, 212, 0.318796992481203, 31.88),
    "Sports": (615, 209, 0.33983739837398375, 33.98),
}

# variant: users, successes, conversion, percent, active in week 1, retention, percent
VARIANTS = {
    "A_control": (3518, 19, 0.005400795906765207, 0.5401, 272, 0.07731665719158613, 7.7317),
    "B_treatment": (3476, 18, 0.005178365937859608, 0.5178, 300, 0.08630609896432681, 8.6306),
}
SUMMARY = {
    "control_conversion_rate": 0.005400795906765207,
    "treatment_conversion_rate": 0.005178365937859608,
    "lift_abs": -0.00022242996890559866,
    "lift_abs_pct_points": -0.022242996890559866,
    "lift_rel": -0.041184664768941906,
    "z_stat": -0.1282129972507064,
    "p_value_two_sided": 0.8979804146432537,
}
