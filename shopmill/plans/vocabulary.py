"""The selectors that product, search and best-seller pages are read with, in order of priority."""

TITLE = [
    ("ID", "productTitle"),
    ("CSS_SELECTOR", "h1.a-text-normal"),
    ("CSS_SELECTOR", "span#productTitle"),
    ("CSS_SELECTOR", ".nav-search-label"),
    ("XPATH", "//span[@id='productTitle']"),
]

IMAGE = [
    ("ID", "landingImage"),
    ("CSS_SELECTOR", "#imgBlkFront"),
    ("CSS_SELECTOR", "#main-image"),
    ("CSS_SELECTOR", ".a-dynamic-image"),
    ("XPATH", "//img[@id='landingImage']"),
]

BRAND = [
    ("ID", "bylineInfo"),
    ("CSS_SELECTOR", "#bylineInfo"),
    ("CSS_SELECTOR", "#brand"),
    ("XPATH", "//a[@id='bylineInfo']"),
    ("CSS_SELECTOR", "#bylineInfo_feature_div"),
    ("CSS_SELECTOR", ".po-brand .a-span9"),
    ("CSS_SELECTOR", ".po-brand .a-size-base"),
    ("XPATH", "//a[contains(@class, 'contributorNameID')]"),
    ("XPATH", "//div[@id='bylineInfo_feature_div']//a"),
    ("XPATH", "//div[@id='brandByline_feature_div']//a"),
    ("XPATH", "//tr[contains(.,'Brand')]/td[2]"),
    ("XPATH", "//div[contains(@class, 'po-brand')]//span[@class='a-size-base']"),
]

CATEGORY = [
    ("XPATH", "//h1[contains(@class, 'a-size-large')]"),
    ("XPATH", "//span[contains(@class, 'zg-banner-text')]"),
    ("XPATH", "//span[@class='category']"),
    ("XPATH", "//title"),
    ("XPATH", "//div[contains(@class, 'category-title')]"),
]


def css(*texts: str) -> list[tuple[str, str]]:
    return [("CSS_SELECTOR", text) for text in texts]


CURRENT_PRICE = css(
    ".a-price .a-offscreen",
    ".apexPriceToPay .a-offscreen",
    '.a-price[data-a-size="l"] .a-offscreen',
    "#priceblock_ourprice",
    "#priceblock_dealprice",
    '.a-price:not([data-a-strike="true"]) .a-offscreen',
    ".reinventPriceAccordionT2 .a-price .a-offscreen",
)
WHOLE_PRICE = css(".a-price-whole")
PRICE_FRACTION = css(".a-price-fraction")
ORIGINAL_PRICE = css(
    '.a-text-price[data-a-strike="true"] .a-offscreen',
    ".a-text-price .a-offscreen",
    "#priceblock_listprice",
    '.a-price[data-a-strike="true"] .a-offscreen',
    ".a-text-strike",
)
SAVINGS_AMOUNT = css(".savingsPercentage", ".priceBlockSavingsString")
SAVINGS_PERCENTAGE = css(".savingsPercentage")
# A second way to read the current price: the element of the first list that exists, else any of the second
# list that holds a number.
ALTERNATIVE_PRICE = css(
    ".apexPriceToPay .a-offscreen",
    ".a-price .a-offscreen",
    "#priceblock_ourprice",
    "#priceblock_dealprice",
    '.a-price.a-text-price span[aria-hidden="true"]',
)
ALTERNATIVE_PRICE_RETRY = css(
    ".apexPriceToPay .a-offscreen",
    ".a-price .a-offscreen",
    '.a-price.a-text-price span[aria-hidden="true"]',
    "#priceblock_ourprice",
    "#priceblock_dealprice",
)

RATING_CLASS = css("[class*='a-size-base a-color-base']")
RATING_TEXT = css(".a-icon-alt")

DESCRIPTION_SECTIONS = [
    ("productDescription", "Product Description"),
    ("feature-bullets", "Key Features"),
    ("productDetails_techSpec_section_1", "Technical Details"),
    ("detailBullets_feature_div", "Product Details"),
]
# Keyword in id or class -> kind of content. The keywords are compared in lower case.
CONTENT_TYPES = [
    ("feature-bullets", "Key Features"),
    ("productDescription", "Product Description"),
    ("technical", "Technical Details"),
    ("detail", "Product Details"),
    ("specification", "Specifications"),
    ("overview", "Product Overview"),
    ("aplus", "Additional Information"),
    ("important", "Important Information"),
]

CART_BUTTONS = css("#add-to-cart-button", "#buy-now-button")
PRICE_ELEMENTS = css(".a-price", "#priceblock_ourprice", "#price")
OUT_OF_STOCK = css("#outOfStock, .out-of-stock")
PREORDER = css("#preOrderButton")
AVAILABILITY_TEXT = css("#availability span", "#merchantInfoFeature", "#buybox-see-all-buying-choices")
AVAILABILITY_ANY_TEXT = [
    *AVAILABILITY_TEXT,
    ("XPATH", '//div[@id="availability"]//span[@class="a-size-medium a-color-success"]'),
    *css("#outOfStock .a-color-price", ".a-color-price", ".a-button-input"),
]
CART_LIKE = css('[id*="add-to-cart"], [id*="addToCart"], [id*="buy-now"]')
PRICE_LIKE = css(".a-price, #price, #priceblock_ourprice, .price-info")

IN_STOCK = "In Stock"
UNAVAILABLE = "Currently unavailable"
PREORDERABLE = "Available for Pre-order"
UNKNOWN_STATUS = "Status Unknown"

SEARCH_ITEM = ("CSS_SELECTOR", '[data-component-type="s-search-result"]')
UNSPONSORED_ITEM = (
    "CSS_SELECTOR",
    '[data-component-type="s-search-result"]:not([data-component-type="sp-sponsored-result"])',
)
SPONSORED = ("CSS_SELECTOR", '[data-component-type="sp-sponsored-result"]')
PRODUCT_LINK = ("CSS_SELECTOR", 'a[href*="/dp/"]')
SEARCH_RANK = css(".zg-badge-text", '[class*="zg-badge"]', ".zg-rank")
# Container and link of the fallbacks, in order.
SEARCH_FALLBACK = [
    ('[data-component-type="s-search-result"]', 'a[href*="/dp/"]'),
    (".s-result-item[data-asin]", 'a.a-link-normal[href*="/dp/"]'),
    (".sg-col-inner", 'a.a-text-normal[href*="/dp/"]'),
    (".s-include-content-margin", 'a.a-link-normal[href*="/dp/"]'),
]

BESTSELLER_BADGE = ("CSS_SELECTOR", '.zg-bdg-text, [class*="zg-badge-text"]')
BESTSELLER_CARD = ("CSS_SELECTOR", '[class*="zg-item"], [class*="zg-grid-item"]')
BESTSELLER_FALLBACK = css(".zg-bdg-text", '[class*="zg-badge-text"]', ".zg-ranking", '[class*="zg-rank"]')
BESTSELLER_CLIMB = 5
