"""Phrase lists, as data.

Operators take dictionaries as arguments; these are the stock ones.  Keys are
in the order in which they are tried: the first match wins.
"""

# Every list and table in this module.

PAGE_TYPES = {
    "about": ["about", "about us", "about our company", "who we are", "our story", "our history", "company", "our company", "overview", "mission", "our mission", "why us", "why choose us", "what we do"],
    "team": ["team", "our team", "meet the team", "meet our team", "staff", "our staff", "people", "our people", "leadership", "management", "founders", "meet us", "practitioners", "attorneys", "agents", "doctors", "stylists", "technicians"],
    "services": ["services", "products", "shop", "menu", "collections", "our services", "what we offer", "offerings", "solutions", "treatments", "programs", "packages", "classes", "capabilities", "specialties", "practice areas", "work", "our work"],
    "contact": ["contact", "contact us", "get in touch", "reach us", "locations", "location", "visit us", "find us", "book", "book now", "appointment", "schedule", "request a quote", "get a quote", "estimate", "consultation"],
    "blog": ["blog", "news", "articles", "insights", "resources", "updates", "press", "newsroom", "stories", "journal", "tips", "guides"],
    "pricing": ["pricing", "prices", "price list", "rates", "plans", "packages", "cost", "fees", "tuition", "membership"],
    "testimonials": ["testimonials", "reviews", "what clients say", "what our clients say", "client stories", "case studies", "success stories", "happy clients", "praise", "feedback"],
    "faq": ["faq", "faqs", "frequently asked questions", "questions", "common questions", "help", "support", "knowledge base"],
}

SOCIAL_DOMAINS = {
    "Facebook": ["facebook.com", "fb.com", "fb.me"],
    "Instagram": ["instagram.com", "instagr.am"],
    "X (Twitter)": ["twitter.com", "x.com", "t.co"],
    "LinkedIn": ["linkedin.com", "lnkd.in"],
    "YouTube": ["youtube.com", "youtu.be"],
    "TikTok": ["tiktok.com"],
    "Pinterest": ["pinterest.com", "pin.it"],
    "Yelp": ["yelp.com", "yelp.to"],
    "Google Business": ["g.page", "business.google.com"],
    "Threads": ["threads.net", "threads.com"],
    "Nextdoor": ["nextdoor.com"],
    "Snapchat": ["snapchat.com"],
    "Reddit": ["reddit.com"],
    "WhatsApp": ["wa.me", "whatsapp.com"],
    "Vimeo": ["vimeo.com"],
    "Bluesky": ["bsky.app"],
    "Mastodon": ["mastodon.social"],
    "GitHub": ["github.com"],
    "Etsy": ["etsy.com"],
    "Houzz": ["houzz.com"],
    "TripAdvisor": ["tripadvisor.com"],
    "Angi": ["angi.com", "angieslist.com"],
    "Thumbtack": ["thumbtack.com"],
    "Eventbrite": ["eventbrite.com"],
    "Spotify": ["open.spotify.com"],
    "Apple Podcasts": ["podcasts.apple.com"],
}

VENDORS = {
    "Google Analytics": ["google-analytics.com", "googletagmanager.com"],
    "Meta Pixel": ["connect.facebook.net"],
    "Google Ads": ["googleadservices.com", "googlesyndication.com"],
    "HubSpot": ["hs-scripts.com", "hubspot.com", "hsforms.net"],
    "Mailchimp": ["mailchimp.com", "list-manage.com", "chimpstatic.com"],
    "Klaviyo": ["klaviyo.com"],
    "Shopify": ["shopify.com", "shopifycdn.com"],
    "Squarespace": ["squarespace.com", "sqspcdn.com"],
    "Wix": ["wix.com", "parastorage.com"],
    "WordPress": ["wp.com", "wordpress.com", "wp-content"],
    "Webflow": ["webflow.com"],
    "Stripe": ["stripe.com", "js.stripe.com"],
    "Square": ["squareup.com", "square.site"],
    "PayPal": ["paypal.com", "paypalobjects.com"],
    "Calendly": ["calendly.com"],
    "Acuity Scheduling": ["acuityscheduling.com"],
    "Mindbody": ["mindbodyonline.com"],
    "OpenTable": ["opentable.com"],
    "Resy": ["resy.com"],
    "Toast": ["toasttab.com"],
    "DoorDash": ["doordash.com"],
    "Intercom": ["intercom.io", "intercomcdn.com"],
    "Zendesk": ["zendesk.com", "zdassets.com"],
    "Tawk.to": ["tawk.to"],
    "Podium": ["podium.com"],
    "Birdeye": ["birdeye.com"],
    "Trustpilot": ["trustpilot.com"],
    "Yotpo": ["yotpo.com"],
    "Google Maps": ["maps.google.com", "maps.googleapis.com"],
    "Cloudflare": ["cloudflare.com", "cloudflareinsights.com"],
    "Vimeo": ["player.vimeo.com"],
    "YouTube Embed": ["youtube.com/embed", "youtube-nocookie.com"],
    "Typeform": ["typeform.com"],
    "Jotform": ["jotform.com"],
    "Gravity Forms": ["gravityforms.com"],
    "Wufoo": ["wufoo.com"],
    "SendGrid": ["sendgrid.com", "sendgrid.net"],
    "Mailgun": ["mailgun.com", "mailgun.org"],
    "Twilio": ["twilio.com"],
    "DialogTech": ["dialogtech.com"],
    "CallRail": ["callrail.com"],
    "Plausible": ["plausible.io"],
    "Hotjar": ["hotjar.com"],
    "Amazon Web Services": ["amazonaws.com", "cloudfront.net"],
    "Rackspace": ["rackspace.com", "rackcdn.com"],
    "Box": ["box.com", "boxcdn.net"],
    "Yext": ["yext.com", "yextapis.com"],
    "BrightLocal": ["brightlocal.com"],
    "TransUnion": ["transunion.com"],
    "Authorize.Net": ["authorize.net"],
    "Elementor": ["elementor.com"],
    "HoneyBook": ["honeybook.com"],
    "ServiceTitan": ["servicetitan.com"],
    "Jobber": ["getjobber.com"],
    "Housecall Pro": ["housecallpro.com"],
}

VENDOR_KINDS = {
    "Google Analytics": ["analytics"],
    "Meta Pixel": ["advertising"],
    "Google Ads": ["advertising"],
    "HubSpot": ["crm-marketing"],
    "Mailchimp": ["email-marketing"],
    "Klaviyo": ["email-marketing"],
    "Shopify": ["commerce"],
    "Squarespace": ["site-platform"],
    "Wix": ["site-platform"],
    "WordPress": ["site-platform"],
    "Webflow": ["site-platform"],
    "Stripe": ["payments"],
    "Square": ["payments"],
    "PayPal": ["payments"],
    "Calendly": ["scheduling"],
    "Acuity Scheduling": ["scheduling"],
    "Mindbody": ["scheduling"],
    "OpenTable": ["reservations"],
    "Resy": ["reservations"],
    "Toast": ["commerce"],
    "DoorDash": ["delivery"],
    "Intercom": ["support-chat"],
    "Zendesk": ["support-chat"],
    "Tawk.to": ["support-chat"],
    "Podium": ["reviews-messaging"],
    "Birdeye": ["reviews-messaging"],
    "Trustpilot": ["reviews"],
    "Yotpo": ["reviews"],
    "Google Maps": ["maps"],
    "Cloudflare": ["infrastructure"],
    "Vimeo": ["media-embed"],
    "YouTube Embed": ["media-embed"],
    "Typeform": ["forms"],
    "Jotform": ["forms"],
    "Gravity Forms": ["forms"],
    "Wufoo": ["forms"],
    "SendGrid": ["email-delivery"],
    "Mailgun": ["email-delivery"],
    "Twilio": ["messaging"],
    "DialogTech": ["call-tracking"],
    "CallRail": ["call-tracking"],
    "Plausible": ["analytics"],
    "Hotjar": ["analytics"],
    "Amazon Web Services": ["infrastructure"],
    "Rackspace": ["infrastructure"],
    "Box": ["file-storage"],
    "Yext": ["listings-management"],
    "BrightLocal": ["listings-management"],
    "TransUnion": ["identity-credit"],
    "Authorize.Net": ["payments"],
    "Elementor": ["site-platform"],
    "HoneyBook": ["crm-marketing"],
    "ServiceTitan": ["field-service"],
    "Jobber": ["field-service"],
    "Housecall Pro": ["field-service"],
}

NOISE_EXACT = ["skip to content", "skip to main content", "skip to navigation", "skip navigation", "skip to footer", "skip to the content", "close", "close menu", "close modal", "close dialog", "dismiss", "cancel", "reset", "clear", "clear all", "clear filters", "remove", "menu", "main menu", "open menu", "toggle menu", "toggle navigation", "navigation", "search", "submit search", "clear search", "cart", "bag", "basket", "shopping cart", "view cart", "open cart", "back", "back to top", "go to top", "scroll to top", "top", "next", "previous", "prev", "next page", "previous page", "first", "last", "load more", "show more", "show less", "expand", "collapse", "log in", "login", "sign in", "log out", "sign out", "register", "create account", "my account", "account", "wishlist", "compare", "filter", "filters", "sort", "sort by", "share", "print", "accept", "accept all", "accept cookies", "reject", "reject all", "decline", "manage preferences", "cookie settings", "got it", "ok", "okay", "continue", "continue shopping", "keep shopping", "quick view", "quick add", "add to cart", "add to bag", "add to basket", "buy now", "checkout", "sold out", "out of stock", "country region", "language", "currency", "increase quantity", "decrease quantity", "quantity", "play", "pause", "mute", "unmute", "read more", "more"]

NOISE_CONTAINS = ["your cart is empty", "your bag is empty", "your basket is empty", "we use cookies", "this site uses cookies", "this website uses cookies", "by continuing to use this site", "by clicking accept", "enable javascript", "javascript seems to be disabled", "your browser is not supported", "please enable cookies", "skip to product information", "press the space key then arrow keys", "use left right arrows to navigate", "opens in a new window", "opens external website"]

SIGNALS = {
    "foundingStory": ["founded", "founding", "was established", "established in", "started in", "began in", "opened in", "our story", "it all started", "since 19", "since 20", "three generations", "second generation", "family owned", "family-owned", "took over", "first opened"],
    "targetBuyers": ["our clients", "our customers", "we serve", "we work with", "we help", "homeowners", "business owners", "small business", "families", "couples", "landlords", "property managers", "contractors", "startups", "enterprises", "professionals", "students", "seniors", "parents", "ideal for", "perfect for", "designed for", "built for"],
    "customerNeeds": ["struggling with", "tired of", "frustrated", "worried about", "problem", "pain point", "challenge", "you need", "help you", "solve", "fix", "avoid", "prevent", "peace of mind", "save time", "save money", "no longer have to", "stop worrying"],
    "industryOutlook": ["industry", "the market", "market trends", "trends", "regulations", "compliance", "demand for", "growing", "shifting", "the future of", "changing landscape"],
    "values": ["community", "give back", "giving back", "volunteer", "donate", "donation", "charity", "nonprofit", "sustainab", "eco-friendly", "environmentally", "green", "carbon", "locally owned", "locally-owned", "family owned", "family-owned", "women owned", "woman-owned", "veteran owned", "veteran-owned", "minority owned", "our values", "we believe", "our mission", "committed to", "ethically", "fair trade", "living wage"],
    "differentiators": ["why choose", "what sets us apart", "sets us apart", "what makes us different", "unlike other", "unlike most", "the only", "one of the few", "unique", "our difference", "the difference", "guarantee", "guaranteed", "award-winning", "voted best", "rated", "years of experience", "certified", "no hidden fees", "same-day", "24/7", "free estimate", "satisfaction"],
    "promotions": ["% off", "percent off", "sale", "on sale", "discount", "limited time", "for a limited", "this month", "this week", "special offer", "promotion", "promo code", "coupon", "free consultation", "free estimate this", "save $", "expires", "ends soon", "book by", "now through", "new customer special", "first-time", "seasonal special", "holiday special", "black friday", "spring special", "summer special", "fall special", "winter special"],
    "businessModel": ["subscription", "membership", "retainer", "hourly rate", "per hour", "flat rate", "flat fee", "franchise", "wholesale", "retail", "e-commerce", "brick and mortar", "by appointment", "walk-ins welcome", "b2b", "b2c", "direct-to-consumer"],
    "serviceArea": ["serving", "we serve", "service area", "areas we serve", "proudly serving", "surrounding areas", "greater", "county", "metro area", "throughout", "within a", "mile radius", "nationwide", "statewide", "locally"],
}

DEMOGRAPHICS = {
    "ageRange": ["ages 18", "ages 21", "ages 55", "ages 65", "18-34", "25-54", "35-54", "55+", "65+", "adults", "seniors", "retirees", "teens", "children", "toddlers", "young professionals", "millennials", "gen z", "boomers"],
    "incomeBracket": ["luxury", "high-end", "premium", "affordable", "budget-friendly", "value-priced", "cost-effective", "low-income", "medicaid", "sliding scale", "financing available", "payment plans"],
    "householdType": ["families", "single-family", "multi-family", "homeowners", "renters", "apartment", "condo", "new parents", "empty nesters", "pet owners", "households"],
}

ROLES = {
    "Manufacturer": ["we manufacture", "our manufacturing", "manufacturer of", "we build our own", "our factory"],
    "Distributor": ["distributor of", "we distribute", "wholesale supplier", "wholesaler"],
    "Contractor": ["general contractor", "licensed contractor", "we are a contractor", "contracting company"],
    "Agency": ["we are an agency", "our agency", "full-service agency", "marketing agency", "creative agency"],
    "Consultancy": ["consulting firm", "we are a consultancy", "consultancy", "advisory firm"],
    "Retailer": ["our retail", "retail location", "our store", "we are a retailer", "online store", "shop our collection"],
    "Service provider": ["service provider", "full-service", "services company", "we provide services", "our services include"],
}

AUDIENCES = {
    "Direct-to-Consumer (D2C)": ["direct-to-consumer", "direct to consumer", "d2c"],
    "Business-to-Business (B2B)": ["business-to-business", "b2b"],
}

GENERIC_CATEGORIES = ["service", "services", "product", "products", "offering", "offerings", "solution", "solutions", "package", "packages", "plan", "plans", "core feature", "feature", "features", "general", "other", "misc", "miscellaneous", "uncategorized", "uncategorised", "all", "shop", "store"]

OFFERING_SIGNALS = ["add to cart", "add to bag", "add to basket", "buy now", "shop now", "select options", "choose options", "quick view", "quick add", "regular price", "sale price", "unit price", "starting at $", "sold out", "in stock", "low stock", "out of stock", "best value", "free shipping", "quantity", "sku", "add to wishlist", "view product", "product details", "size guide", "checkout"]

PRICING_MODELS = ["per project", "per service call", "per inspection", "per visit", "per hour", "per unit", "per person", "per month", "per year", "by quote", "by estimate", "quote/estimate", "on request", "upon request", "request a quote", "free estimate", "free inspection", "free consultation", "no charge", "complimentary", "included with", "included in", "custom subscription", "custom pricing", "custom quote", "subscription", "membership", "maintenance contract", "service contract", "retainer", "event-based", "partnership model", "reseller model", "flat rate", "flat fee", "hourly rate", "financing available", "payment plans", "loan terms vary", "contact for pricing", "call for pricing", "varies"]

STOPWORDS = ["the", "a", "an", "and", "or", "but", "of", "to", "in", "on", "at", "for", "with", "by", "from", "as", "is", "are", "was", "were", "be", "been", "our", "your", "we", "us", "you", "they", "it", "its", "this", "that", "these", "those", "all", "more", "most", "other", "new", "best", "top", "great", "good", "get", "got", "make", "made", "how", "what", "why", "when", "where", "who", "can", "will", "may", "home", "page", "menu", "click", "here", "read", "learn", "view", "see", "back", "next", "previous", "close", "open", "skip", "content", "site", "website", "search", "toggle", "navigation", "footer", "header", "copyright", "rights", "reserved", "cart", "account", "login", "sign", "up", "out", "now", "today", "call", "email", "phone", "address", "hours", "location", "about", "contact", "services", "products", "shop", "blog", "news", "faq", "team", "reviews", "testimonials", "welcome"]

LEGAL_SUFFIXES = ["LLC", "L.L.C.", "Inc", "Inc.", "Incorporated", "Corp", "Corp.", "Corporation", "Ltd", "Ltd.", "Limited", "LLP", "LP", "PLLC", "PC", "P.C.", "Co.", "Company", "GmbH", "Pty Ltd", "S.A.", "B.V."]
