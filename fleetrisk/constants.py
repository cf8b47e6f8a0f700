"""Fixed values of the risk, pricing and fraud model.

Everything in this module must equal the published model for results to match,
so the values are stated plainly and carry no logic.
"""

# --- fixed values: risk bands and band-keyed tables ------------------------
BANDS = ("Low", "Medium", "High", "Critical")
BAND_MEDIUM_MIN = 0.31
BAND_HIGH_MIN = 0.51
BAND_CRITICAL_MIN = 0.81
BAND_MULTIPLIER = {"Low": 0.62, "Medium": 1.00, "High": 1.42, "Critical": 1.95}
BAND_EXPECTED_CLAIM = {"Low": 750.0, "Medium": 2200.0, "High": 6200.0, "Critical": 10000.0}
BAND_REVIEW_ACTION = {
    "Low": "Monitor",
    "Medium": "Recommend Coaching",
    "High": "Schedule Inspection",
    "Critical": "Immediate Review",
}
BAND_POLICY_ACTION = {
    "Low": "standard_offer",
    "Medium": "monitoring",
    "High": "surcharge",
    "Critical": "decline",
}
BAND_SCORE_PROXY = {"Low": 0.20, "Medium": 0.45, "High": 0.72, "Critical": 0.90}

# --- fixed values: vehicle classes -----------------------------------------
PUBLIC_TRANSPORT_TYPES = ("Kombi", "Minibus", "Bus")
COMMERCIAL_TYPES = ("Pickup", "Van", "Light Truck", "Heavy Truck")
PUBLIC_PRICING_TYPES = ("Kombi", "Minibus", "Pickup", "Heavy Truck")

# --- fixed values: environment risk on the 0..1 scale ----------------------
WEATHER_RISK = {
    "Sunny": 0.10, "Cloudy": 0.20, "Windy": 0.45, "Rainy": 0.65,
    "Hot": 0.60, "Snowy": 0.80, "Stormy": 0.85,
}
ROAD_RISK = {
    "Highway": 0.20, "Urban": 0.35, "Local Streets": 0.35, "Rural Tarred": 0.25,
    "Gravel": 0.60, "Potholed": 0.75, "Unknown": 0.40,
}
TIME_RISK = {
    "Morning Rush": 0.35, "Mid-Day": 0.20, "Evening Rush": 0.40,
    "Night": 0.70, "Late Night": 0.75, "Dawn": 0.30,
}
DAY_RISK = {
    "Monday": 0.25, "Tuesday": 0.25, "Wednesday": 0.25, "Thursday": 0.25,
    "Friday": 0.35, "Saturday": 0.40, "Sunday": 0.35,
}
CITY_RISK = {
    "Harare": 0.50, "Bulawayo": 0.45, "Mutare": 0.40, "Gweru": 0.35, "Masvingo": 0.30,
    "Kwekwe": 0.20, "Kadoma": 0.18, "Chinhoyi": 0.18, "Victoria Falls": 0.18,
    "Beitbridge": 0.18, "Chegutu": 0.18, "Redcliff": 0.18, "Zvishavane": 0.18,
    "Shurugwi": 0.18, "Plumtree": 0.18, "Macheke": 0.18, "Mvuma": 0.18, "Gwanda": 0.18,
}

# --- fixed values: weather factor on the 0.7..1.3 scale (feature engineering)
WEATHER_FACTOR = {
    "Sunny": 0.8, "Partly Cloudy": 0.9, "Hazy": 1.0, "Light Rain": 1.1,
    "Thundery / Heavy Rain": 1.3, "Foggy": 1.3, "Clear": 0.8, "Hot": 0.9,
    "Hot / Scorching": 1.1, "Cold": 0.8, "Cold / Freezing": 0.7, "Mild": 0.85,
    "Mild / Balmy": 0.85, "Windy": 1.0, "Windy / Gusty": 1.15, "Misty": 1.2,
    "Misty / Foggy": 1.25,
}
WEATHER_FACTOR_CEILING = 1.3

# --- fixed values: road speed limits (km/h) and city centroids -------------
ROAD_MAX_SPEED = {
    "Highway": 160.0, "Gravel": 70.0, "Potholed": 45.0,
    "Local Streets": 60.0, "Urban": 85.0, "Rural Tarred": 110.0,
}
CITY_CENTROIDS = {
    "Harare": (-17.8252, 31.0335), "Bulawayo": (-20.1320, 28.6265),
    "Gweru": (-19.455, 29.820), "Mutare": (-18.9707, 32.6709),
    "Masvingo": (-20.070, 30.829), "Kwekwe": (-18.921, 29.816),
    "Kadoma": (-18.340, 29.900), "Chinhoyi": (-17.350, 30.200),
    "Victoria Falls": (-17.925, 25.856), "Beitbridge": (-22.217, 30.000),
    "Chegutu": (-18.130, 30.150), "Redcliff": (-19.033, 29.783),
    "Zvishavane": (-20.330, 30.046), "Shurugwi": (-19.667, 30.000),
    "Plumtree": (-20.478, 27.797), "Macheke": (-18.139, 31.849),
    "Mvuma": (-19.283, 30.533), "Gwanda": (-20.939, 29.005),
}
DEFAULT_CITY = "Harare"

# --- fixed values: scoring bins, (lower edge, risk); the last bin is open ---
SPEED_RATIO_BINS = ((0.0, 0.00), (1.01, 0.20), (1.10, 0.45), (1.20, 0.70), (1.30, 0.90))
SPEED_EXCESS_BINS = ((0.0, 0.10), (5.1, 0.30), (10.1, 0.60), (20.1, 0.85), (30.1, 0.98))
HARSH_PER_HOUR_BINS = ((0.0, 0.10), (2.0, 0.30), (4.0, 0.55), (6.0, 0.80), (8.0, 0.95))
HARSH_PER_KM_BINS = ((0.0, 0.10), (0.5, 0.30), (1.0, 0.55), (2.0, 0.80), (3.0, 0.95))
HARSH_COUNT_BINS = ((0.0, 0.05), (2.0, 0.20), (5.0, 0.45), (10.0, 0.70), (15.0, 0.90))
ENGINE_STRESS_BINS = ((0.0, 0.05), (20.0, 0.20), (40.0, 0.45), (60.0, 0.70), (80.0, 0.95))
COOLANT_BINS = ((0.0, 0.05), (90.0, 0.20), (100.0, 0.50), (105.0, 0.80), (110.0, 0.98))
BATTERY_BINS = ((0.0, 0.90), (11.8, 0.60), (12.2, 0.35), (12.4, 0.15), (12.6, 0.05))

# --- fixed values: time-of-day buckets, (first hour, label) ----------------
NIGHT_BUCKETS = ("Night", "Late Night", "Dawn")
WEEKEND_DAYS = ("Saturday", "Sunday")

# --- fixed values: pricing -------------------------------------------------
BASE_PREMIUM = {
    "Sedan": 600.0, "Hatchback": 480.0, "Station Wagon": 550.0, "SUV": 900.0,
    "Pickup": 1100.0, "Van": 550.0, "Kombi": 520.0, "Minibus": 520.0, "Bus": 400.0,
    "Light Truck": 1400.0, "Heavy Truck": 2400.0, "Fuel Tanker": 2300.0,
    "Tipper Truck": 2100.0, "Tractor": 350.0, "Luxury": 1200.0,
}
BASE_PREMIUM_DEFAULT = 600.0
BASE_PREMIUM_LIST_PRICE_DEFAULT = 8000.0
USD_TO_ZIG_RATE = 26.5
CLAIM_SEVERITY_RATIO = 0.10
POLICY_ACTIONS = ("standard_offer", "monitoring", "surcharge", "decline")
POLICY_MULTIPLIER = {"standard_offer": 0.85, "monitoring": 1.00, "surcharge": 1.25, "decline": 0.00}
ACTION_CODE = {"Low": 0, "Medium": 1, "High": 2, "Critical": 3}
ACTION_CONTROL_COST = {"Low": 0.0, "Medium": 8.0, "High": 5.5, "Critical": 7.5}
BAND_EXPENSE_LOADING = {"Low": 0.0, "Medium": 0.005, "High": 0.01, "Critical": 0.02}
PRIVATE_EXPENSE_RATIO = 0.12
COMMERCIAL_EXPENSE_RATIO = 0.16
PRIVATE_ADMIN_COST = 0.25
COMMERCIAL_ADMIN_COST = 0.5

# --- fixed values: policy evaluation (by action code 0..3) -----------------
EVAL_PREMIUM_MULTIPLIER = (1.00, 1.10, 1.25, 0.00)
EVAL_LOSS_MULTIPLIER = (1.00, 0.92, 0.78, 0.00)
EVAL_INTERVENTION_COST = (0.0, 20.0, 40.0, 15.0)

# --- fixed values: fraud ---------------------------------------------------
SEVERITY_HOLD_HOURS = {"Critical": 72.0, "High": 48.0, "Medium": 24.0, "Low": 12.0}
SEVERITY_COLOUR = {
    "Critical": "🔴 Red",
    "High": "🟠 Orange",
    "Medium": "🟡 Yellow",
    "Low": "🟢 Green",
}
SEVERITY_FRAUD_TYPE = {
    "Critical": "Hard fraud (staged accidents)",
    "High": "Tampering + Ghost vehicles",
    "Medium": "Soft fraud (exaggerated claims)",
    "Low": "Rating evasion (misrepresentation)",
}
SEVERITY_ACTION = {
    "Critical": "Immediate action required",
    "High": "Investigate urgently",
    "Medium": "Review within 48 hours",
    "Low": "Routine adjustment",
}

# --- fixed values: driver advice texts -------------------------------------
ADVICE = {
    "band_high": "Risk band is elevated; schedule a safety coaching session and inspect driving behavior.",
    "band_medium": "Risk band is moderate; monitor driving and reinforce safe habits.",
    "band_low": "Risk band is low; continue safe driving practices.",
    "speeding": "Reduce speeding and stay within road limits to lower risk.",
    "harsh_many": "Avoid hard braking, sudden acceleration, and sharp cornering to improve safety.",
    "harsh_some": "Minimize harsh events by driving smoothly and anticipating stops.",
    "fuel_high": "Improve fuel efficiency with steadier acceleration and slower cruising speeds.",
    "fuel_low": "Current fuel efficiency is strong; keep maintaining smooth driving behavior.",
    "premium_high": "Premium is high; reduce risk factors like speeding, harsh events, and risky routes to lower cost.",
    "premium_mid": "Premium is above average; focus on safer driving and better fuel economy to prevent further increases.",
    "premium_low": "Premium is moderate; maintain current safe habits to keep premiums stable.",
    "claim_high": "Expected claim exposure is elevated; reducing risk score will help contain future premium growth.",
    "profit_negative": "Underwriting profit is negative; lowering risk and improving claim expectations can improve pricing and profitability.",
    "profit_ok": "Premium coverage appears aligned; continue safe driving to preserve pricing efficiency.",
    "fraud": "Review the vehicle for possible fraud or anomalous behavior flagged by SHAP patterns.",
    "driving": "The vehicle is currently driving; remind the driver to maintain safe routing and avoid distractions.",
    "parked": "The vehicle is parked; once driving resumes, continue to monitor for safe behavior.",
    "commercial": "Commercial usage requires consistent safe driving; enforce fleet policies and check route planning.",
}

# --- fixed values: column sets of the snapshot tables ----------------------
STATIC_COLUMNS = (
    "Plate", "Type", "Make", "Model", "Class", "Year", "Engine_CC", "Base_Price_USD",
    "City", "Usage", "Policy_Status", "Policy_Start_Date", "Effective_Date",
    "Policy_End_Date", "Expiry_Date", "Premium_Payment_Status", "Outstanding_Balance",
)
DYNAMIC_COLUMNS = (
    "Trip_ID", "Road_Type", "Weather", "Status", "Direction", "Trip_Distance_km",
    "Trip_Duration_Hour", "Speed_kmh", "Acceleration_mps2", "RPM", "Throttle_pct",
    "Engine_Load_pct", "Coolant_Temp_C", "MAF_gs", "Battery_V", "GPS_Latitude",
    "GPS_Longitude", "Harsh_Brake_Count", "Harsh_Accel_Count", "Harsh_Corner_Count",
    "Total_Harsh_Events_per_Day", "Fuel_Efficiency_L_per_100km", "Last_Update",
    "Speeding_Flag", "Status_Change_Timestamp", "Time_of_Day", "Day_of_Week",
)
RAW_COLUMNS = STATIC_COLUMNS + DYNAMIC_COLUMNS
ENGINEERED_COLUMNS = (
    "Max_Speed_kmh", "Speed_Variance", "Max_Acceleration_mps2", "Max_Deceleration_mps2",
    "Battery_Health_Score", "Recent_Harsh_Events", "Recent_Avg_Speed",
    "Recent_Speeding_Ratio", "Recent_Night_Distance", "Avg_Speed_Last_7_Days",
    "Total_Harsh_Events_Last_30_Days", "Speeding_Ratio_x_Night_Driving_Ratio",
    "Potholed_Ratio", "Gravel_Ratio", "Highway_Ratio", "Urban_Ratio", "Vehicle_Age_Years",
    "Trip_Duration_Minutes", "Weather_Risk_Score", "Driving_Event_Score",
    "Aggressive_Driving_Score", "Fatigue_Risk_Score", "Night_Driving_Flag",
    "Base_Road_Max_Speed_kmh", "Speeding_Excess_kmh", "Coolant_Overheat_Flag",
    "Update_Year", "Update_Month", "Update_Day", "Update_Hour", "Update_Minute",
)
PREPROCESSED_COLUMNS = RAW_COLUMNS + ENGINEERED_COLUMNS
FLEET_MODEL_YEAR = 2026

SCHEDULE_COLUMNS = (
    "Plate", "Type", "City", "Make", "Model", "Usage", "Risk_Score", "Risk_Band",
    "Recommended_Action", "Base_Price_USD", "Expected_Claim_USD", "Daily_Premium_USD",
    "Monthly_Premium_USD", "Underwriting_Expenses_USD", "Underwriting_Profit_USD",
    "Expected_Claim_ZIG", "Daily_Premium_ZIG", "Monthly_Premium_ZIG",
    "Underwriting_Expenses_ZIG", "Underwriting_Profit_ZIG",
)
LIVE_RISK_COLUMNS = (
    "Plate", "Type", "City", "Make", "Model", "Risk_Score", "Risk_Band", "PPO_Action",
    "Premium_Multiplier", "Speed_kmh", "Speeding_Excess_kmh", "Acceleration_mps2",
    "Harsh_Events_Per_Day", "Aggressive_Driving_Score", "Weather_Risk_Score",
    "Road_Type_Risk_Score", "Time_of_Day_Risk_Score", "Night_Driving_Flag",
    "Fatigue_Risk_Score", "Recent_Avg_Speed", "Recent_Harsh_Events",
    "Recent_Night_Distance", "Engine_CC", "Year",
)
PREDICTION_COLUMNS = (
    "Plate", "Type", "City", "City_Risk_Score", "Speed_kmh", "Recent_Harsh_Events",
    "Road_Type", "Weather", "Time_of_Day", "Calculated_Risk_Score", "Risk_Band",
    "Expected_Claim",
)
RECOMMENDATION_COLUMNS = (
    "Plate", "City", "Type", "Speed_kmh", "Risk_Band", "Calculated_Risk_Score",
    "Expected_Claim", "Risk_Action", "Speeding_Risk", "Harsh_Risk", "Engine_Risk",
    "Environmental_Risk", "Vehicle_Condition_Risk", "Behavioral_Risk",
)
OVERVIEW_COLUMNS = (
    "Plate", "Type", "City", "City_Risk_Score", "Risk_Band", "Speed_kmh",
    "Recent_Harsh_Events", "Calculated_Risk_Score", "Monthly_Premium_USD",
)
FLAGGED_COLUMNS = (
    "Plate", "Model", "Type", "Status", "Speed_kmh", "Speeding_Excess_kmh",
    "Aggressive_Driving_Score", "Total_Distance_Monthly_km", "MAF_gs", "RPM",
    "Engine_Load_pct", "Risk_Band", "Risk_Score", "Anomaly_Score", "Fraud_Probability",
    "Fraud_Risk_Flag", "Data_Consistency_Score", "Colour", "Severity",
    "Fraud_Types_Included", "Action", "Timestamp", "Detection_Layers_Triggered",
)
CORRELATION_COLUMNS = (
    "Risk_Score", "Anomaly_Score", "Fraud_Probability", "Data_Consistency_Score",
    "Speeding_Excess_kmh", "Aggressive_Driving_Score", "Harsh_Events_Per_Day",
    "Recent_Harsh_Events", "Engine_Load_pct", "RPM", "MAF_gs", "Weather_Risk_Score",
    "Road_Type_Risk_Score", "Time_of_Day_Risk_Score", "Fatigue_Risk_Score",
    "Recent_Avg_Speed", "Recent_Night_Distance",
)
FILTERABLE_COLUMNS = ("Type", "City", "Usage", "Road_Type", "Weather", "Status", "Make", "Model")

# --- fixed values: model training ------------------------------------------
ID_COLUMNS = ("Plate", "Trip_ID", "Last_Update")
TARGET_COLUMNS = ("Risk_Label", "Risk_Score", "Claim_Probability", "Claim_Label")
TRAINING_DROPPED = (
    "Trip_ID", "GPS_Latitude", "GPS_Longitude", "Status", "Total_Harsh_Events_per_Day",
    "Harsh_Brake_Count", "Harsh_Accel_Count", "Harsh_Corner_Count", "Trip_Distance_km",
    "Trip_Duration_Hour", "Fuel_Efficiency_L_per_100km", "Direction",
)
DUMMY_COLUMNS = ("Road_Type", "Weather")
