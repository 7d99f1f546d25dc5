"""Word lists and patterns of the matching semantics."""

# Stop words.
STOP_WORDS = [
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "is", "are",
    "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "shall", "can", "need", "dare", "ought", "used", "this", "that", "these", "those", "i",
    "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves", "he",
    "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself", "they", "them", "their",
    "theirs", "themselves", "what", "which", "who", "whom", "whose", "when", "where", "why", "how", "all", "each",
    "every", "both", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so",
    "than", "too", "very", "just", "because", "as", "until", "while", "about", "between", "through", "during",
    "before", "after", "above", "below", "up", "down", "out", "off", "over", "under", "again", "further", "then",
    "once", "here", "there", "any", "also", "etc", "able", "using", "work", "working", "including",
]

# Skills, in the order in which they are reported.
SKILLS = [
    "javascript", "typescript", "python", "java", "c++", "c#", "go", "golang", "rust", "ruby", "php", "swift",
    "kotlin", "scala", "r", "matlab", "perl", "haskell", "elixir", "clojure", "dart", "lua", "objective-c",
    "assembly", "cobol", "fortran", "groovy", "julia", "react", "angular", "vue", "svelte", "next.js", "nuxt",
    "gatsby", "html", "css", "sass", "less", "tailwind", "bootstrap", "material-ui", "webpack", "vite", "babel",
    "jquery", "redux", "mobx", "zustand", "node.js", "express", "django", "flask", "fastapi", "spring", "spring-boot",
    "rails", "laravel", "asp.net", ".net", "gin", "fiber", "nest.js", "graphql", "rest", "grpc", "websocket",
    "microservices", "sql", "mysql", "postgresql", "mongodb", "redis", "elasticsearch", "cassandra", "dynamodb",
    "firebase", "supabase", "sqlite", "oracle", "mariadb", "neo4j", "couchdb", "influxdb", "aws", "azure", "gcp",
    "docker", "kubernetes", "terraform", "ansible", "jenkins", "github-actions", "gitlab-ci", "circleci", "ci/cd",
    "nginx", "apache", "linux", "bash", "shell", "cloudformation", "pulumi", "helm", "istio", "prometheus", "grafana",
    "datadog", "splunk", "elk", "machine-learning", "deep-learning", "tensorflow", "pytorch", "keras", "scikit-learn",
    "pandas", "numpy", "scipy", "spark", "hadoop", "airflow", "kafka", "flink", "dbt", "snowflake", "bigquery",
    "tableau", "power-bi", "looker", "data-engineering", "etl", "nlp", "computer-vision", "reinforcement-learning",
    "react-native", "flutter", "ios", "android", "swiftui", "jetpack-compose", "xamarin", "ionic", "cordova", "jest",
    "mocha", "cypress", "selenium", "playwright", "pytest", "junit", "rspec", "testing-library", "vitest",
    "storybook", "git", "github", "gitlab", "bitbucket", "jira", "confluence", "agile", "scrum", "kanban", "tdd",
    "bdd", "solid", "design-patterns", "system-design", "architecture", "oauth", "jwt", "ssl", "encryption",
    "penetration-testing", "soc2", "gdpr", "hipaa", "cybersecurity",
]

# Phrases reported as skills; each starts and ends with a word character. With each what
# all its matches hold.
PHRASES = {
    r"\d+\+?\s*years?\s*(?:of\s*)?experience": ["year", "experience"],
    r"full[- ]?stack": ["full", "stack"],
    r"front[- ]?end": ["front", "end"],
    r"back[- ]?end": ["back", "end"],
    r"data\s*scien(?:ce|tist)": ["data", "scien"],
    r"devops\s*engineer": ["devops", "engineer"],
    r"site\s*reliability": ["site", "reliability"],
    r"project\s*management": ["project", "management"],
    r"product\s*management": ["product", "management"],
}

# Technical terms kept beside the words of a text, by groups that are searched in turn.
TECH_TERMS = [
    [r"node\.js", r"react\.js", r"vue\.js", r"next\.js", r"express\.js"],
    [r"c\+\+", "c#", r"\.net", "f#"],
    ["aws", "gcp", "azure", "docker", "kubernetes", "k8s"],
    ["postgresql", "mongodb", "mysql", "redis", "elasticsearch"],
    ["tensorflow", "pytorch", "scikit-learn", "pandas", "numpy"],
    ["ci/cd", "devops", r"rest\s*api", "graphql"],
    [r"machine\s*learning", r"deep\s*learning", r"natural\s*language\s*processing"],
]
