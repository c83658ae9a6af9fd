"""The product's feature catalogue: loaded once, never part of a daily batch."""

# The feature catalogue (name, category, minimum plan, core, status,
# adoption difficulty, retention impact).
FEATURES = [
    ("login", "core", "starter", True, "active", "low", "medium"),
    ("create_invoice", "billing", "starter", True, "active", "low", "high"),
    ("send_payment_reminder", "billing", "starter", True, "active", "low", "medium"),
    ("process_payment", "payments", "starter", True, "active", "medium", "high"),
    ("book_service", "scheduling", "starter", True, "active", "medium", "medium"),
    ("view_customer_history", "crm", "starter", True, "active", "low", "medium"),
    ("automated_followup", "automation", "pro", False, "active", "medium", "high"),
    ("export_report", "reporting", "pro", False, "active", "medium", "medium"),
    ("advanced_reporting", "reporting", "business", False, "active", "high", "high"),
    ("team_task_assignment", "operations", "pro", False, "active", "medium", "medium"),
    ("client_portal", "crm", "pro", False, "active", "medium", "high"),
    ("recurring_invoice", "billing", "pro", False, "active", "medium", "high"),
    ("contract_template", "operations", "business", False, "beta", "high", "medium"),
    ("tax_summary", "reporting", "business", False, "active", "high", "medium"),
    ("integration_settings", "integrations", "business", False, "deprecated", "high", "high"),
]
