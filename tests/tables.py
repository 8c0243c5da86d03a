"""The acceptance tables and the outcomes expected of them."""

V1 = ("row_id bigint, id bigint, name string, email string, department string", [
    (0, 1, " Nguyen Van A ", "a@test.com", "HR"),
    (1, 2, "Tran Thi B ", "b@test.com", "Finance"),
    (2, 3, " Le Van C", "c@test.com", "IT"),
    (3, 4, "Pham Thi D", "d@test.com", "HR"),
    (4, 5, "  Hoang Van E  ", "e@test.com", "Finance"),
])
V2 = ("row_id bigint, id bigint, name string, hire_date string, department string", [
    (0, 1, "Nguyen Van A", "2024-01-15", "HR"),
    (1, 2, "Tran Thi B", "15/01/2024", "Finance"),
    (2, 3, "Le Van C", "2024-02-20", "IT"),
    (3, 4, "Pham Thi D", "20-02-2024", "HR"),
    (4, 5, "Hoang Van E", "2024-03-10", "Finance"),
    (5, 6, "Do Van F", "10/03/2024", "IT"),
])
V3 = ("row_id bigint, employee_id string, name string, email string, department string", [
    (0, "E001", "Nguyen Van A", "a@company.com", "HR"),
    (1, "E002", "Tran Thi B", "b@company.com", "Finance"),
    (2, "E003", "Le Van C", "c@company.com", "IT"),
    (3, "E001", "Nguyen Van A", "a@company.com", "HR"),
    (4, "E004", "Pham Thi D", "d@company.com", "Marketing"),
    (5, "E002", "Tran Thi B", "b2@company.com", "Finance"),
])
V4 = ("row_id bigint, employee_id string, name string, salary bigint, department string", [
    (0, "E001", "Nguyen Van A", 15000000, "HR"),
    (1, "E002", "Tran Thi B", 18000000, "Finance"),
    (2, "E003", "Le Van C", 50000000, "IT"),
    (3, "E004", "Pham Thi D", 16000000, "Marketing"),
    (4, "E005", "Hoang Van E", 17000000, "HR"),
])
V5 = ("row_id bigint, transaction_id string, customer string, amount bigint, type string, status string", [
    (0, "TXN001", "Nguyen Van A", 5000000, "payment", "completed"),
    (1, "TXN002", "Tran Thi B", 12000000, "payment", "completed"),
    (2, "TXN003", "Le Van C", 8000000, "refund", "pending"),
    (3, "TXN004", "Pham Thi D", 3000000, "payment", "completed"),
    (4, "TXN005", "Hoang Van E", 15000000, "payment", "completed"),
])
DEMO = ("row_id bigint, employee_id string, full_name string, email string, department string, "
        "hire_date string, salary string, phone bigint, status string", [
    (0, "E001", "Nguyen Van An", "an.nguyen@company.vn", "Engineering", "2023-01-15", "25000000", 901234567, "Active"),
    (1, "E002", " Tran Thi Binh ", "binh.tran@company.vn", "HR", "2023-02-20", "18000000", 912345678, "Active"),
    (2, "E003", "Le Hoang Cuong", "cuong.le@company.vn", "Engineering", "15/03/2023", "28000000", 923456789, "Active"),
    (3, "E004", "Pham Minh Duc", "duc.pham@company.vn", "Finance", "2023-04-10", "22000000", 934567890, "Active"),
    (4, "E005", "Hoang Thi Em", "em.hoang@company.vn", "HR", "2023-05-05", "N/A", 945678901, "Active"),
    (5, "E006", "Vo Van Phuc", "phuc.vo@company.vn", "Marketing", "2023-06-15", "19000000", None, "Active"),
    (6, "E007", "Dang Thi Giang", "giang.dang@company.vn", "Enginering", "2023-07-20", "26000000", 967890123, "Active"),
    (7, "E008", "Bui Quoc Hung", "hung.bui@company.vn", "Finance", "2023-08-01", "150000000", 978901234, "Active"),
    (8, "E001", "Nguyen Van An", "an.nguyen@company.vn", "Engineering", "2023-01-15", "25000000", 901234567, "Active"),
    (9, "E010", "Ly Thi Thanh", "-", "Sales", "2023-09-10", "20000000", 989012345, "active"),
    (10, "E011", "Ngo Van Khoa", "khoa.ngo@company.vn", "Engineering", "2023-10-15", "27000000", 990123456, "Active"),
    (11, "E012", "Do Thi Lan", "lan.do@company.vn", "HR", "2023-11-01", "17000000", 901234568, "Actve"),
])

# table -> (evidence rows, decisions, AUTO, ESCALATE by policy, by authority)
OUTCOMES = {
    "V1": (4, 4, 4, 0, 0), "V2": (3, 3, 3, 0, 0), "V3": (8, 8, 4, 4, 0),
    "V4": (6, 5, 0, 0, 5), "V5": (10, 10, 0, 0, 10), "DEMO": (39, 30, 6, 12, 12),
}
TABLES = {"V1": V1, "V2": V2, "V3": V3, "V4": V4, "V5": V5, "DEMO": DEMO}


def frame(spark, name):
    schema, rows = TABLES[name]
    return spark.createDataFrame(rows, schema)
