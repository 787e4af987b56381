"""Fixed values of the synthetic data: word lists, states and their weights."""

# Fixed values.
MAIL_HOSTS = ["gmail", "naver", "daum", "yahoo"]
FAMILY_NAMES = ["김", "이", "박", "최", "정", "강", "조", "윤", "장", "임"]
GIVEN_NAMES = ["민수", "서연", "도현", "수빈", "준호", "지원", "예진", "현우", "민지", "성민"]
ROOT_CATEGORIES = ["전자제품", "의류", "식품", "가구", "스포츠", "도서", "뷰티", "반려동물"]
BRAND_NAMES = [
    "Samsung",
    "LG",
    "Apple",
    "Sony",
    "Nike",
    "Adidas",
    "Uniqlo",
    "Muji",
    "Ikea",
    "Daiso",
    "Olive Young",
    "Lush",
    "The Body Shop",
    "Innisfree",
]
BRAND_COUNTRIES = ["Korea", "USA", "Japan", "Germany"]
TIERS = ["BRONZE", "SILVER", "GOLD", "PLATINUM", "DIAMOND"]
TIER_WEIGHTS = [50, 30, 15, 4, 1]
USER_STATES = ["ACTIVE", "INACTIVE", "SUSPENDED"]
GENDERS = ["M", "F", "OTHER"]
ADDRESS_TYPES = ["HOME", "OFFICE", "OTHER"]
CITIES = ["Seoul", "Busan", "Daegu", "Incheon", "Gwangju"]
PRODUCT_NAMES = [
    "Smartphone",
    "Laptop",
    "Headphones",
    "T-shirt",
    "Jeans",
    "Sneakers",
    "Watch",
    "Backpack",
    "Sunglasses",
    "Camera",
    "Tablet",
    "Monitor",
]
PRODUCT_STATES = ["ACTIVE", "INACTIVE", "OUT_OF_STOCK"]
ORDER_STATES = ["PENDING", "PROCESSING", "SHIPPED", "DELIVERED", "CANCELLED", "REFUNDED"]
ORDER_WEIGHTS = [10, 20, 30, 30, 5, 5]
SEARCH_TEXTS = [
    "smartphone",
    "laptop",
    "wireless headphones",
    "running shoes",
    "winter jacket",
    "gaming monitor",
    "mechanical keyboard",
    "wireless mouse",
    "smart watch",
    "tablet",
    "camera",
    "backpack",
    "sunglasses",
]

# Row counts of a full data set.
ROWS = {
    "users": 10_000,
    "brands": 100,
    "products": 50_000,
    "orders": 100_000,
    "reviews": 200_000,
    "views": 500_000,
    "searches": 300_000,
}

# Titles and texts of reviews with four or five stars, with three, and with fewer.
REVIEW_TITLES = ("Great product", "Average product", "Poor product")
REVIEW_TEXTS = (
    "This product is amazing. I love it!",
    "This product is okay. I like it!",
    "This product is disappointing. I hate it!",
)

PASSWORD = "hashed_password"
IMAGE_URL = "https://example.com/images/%d_%d.jpg"

# Priorities of queries by more than so many calls of more than so many milliseconds; all others are LOW.
PRIORITIES = (("CRITICAL", 1000, 100), ("HIGH", 500, 50), ("MEDIUM", 100, 10))
