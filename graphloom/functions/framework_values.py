"""What tells that a framework is used: fixed values."""

#: Framework, language, signals (kind, pattern, weight).
FRAMEWORKS = (
    ("flask", "python", (("dependency", "flask", 0.8), ("import", "flask", 0.7),)),
    ("fastapi", "python", (("dependency", "fastapi", 0.8), ("import", "fastapi", 0.7),)),
    ("django", "python", (("dependency", "django", 0.8), ("import", "django", 0.7), ("file", "*manage.py", 0.3), ("file", "*urls.py", 0.2),)),
    ("click", "python", (("dependency", "click", 0.8), ("import", "click", 0.7),)),
    ("typer", "python", (("dependency", "typer", 0.8), ("import", "typer", 0.7),)),
    ("argparse", "python", (("import", "argparse", 0.7),)),
    ("celery", "python", (("dependency", "celery", 0.8), ("import", "celery", 0.7),)),
    ("aws-lambda", "python", (("file", "serverless.y*ml", 0.5), ("file", "template.y*ml", 0.3), ("symbol", "lambda_handler", 0.5),)),
    ("aws-lambda-js", "javascript", (("file", "serverless.y*ml", 0.5), ("file", "template.y*ml", 0.3), ("dependency", "@types/aws-lambda", 0.6), ("dependency", "aws-lambda", 0.5),)),
    ("express", "javascript", (("dependency", "express", 0.8), ("import", "express", 0.7),)),
    ("fastify", "javascript", (("dependency", "fastify", 0.8), ("import", "fastify", 0.7),)),
    ("nestjs", "javascript", (("dependency", "@nestjs/*", 0.8), ("import", "@nestjs/*", 0.7),)),
    ("next", "javascript", (("dependency", "next", 0.8), ("file", "next.config.*", 0.5),)),
    ("react", "javascript", (("dependency", "react", 0.8), ("import", "react", 0.7),)),
    ("gin", "go", (("dependency", "github.com/gin-gonic/gin", 0.8), ("import", "github.com/gin-gonic/gin", 0.7),)),
    ("echo", "go", (("dependency", "github.com/labstack/echo*", 0.8), ("import", "github.com/labstack/echo*", 0.7),)),
    ("cobra", "go", (("dependency", "github.com/spf13/cobra", 0.8), ("import", "github.com/spf13/cobra", 0.7),)),
    ("net/http", "go", (("import", "net/http", 0.7),)),
    ("spring-boot", "java", (("dependency", "*spring-boot*", 0.8), ("import", "org.springframework*", 0.7),)),
    ("jax-rs", "java", (("import", "javax.ws.rs*", 0.7), ("import", "jakarta.ws.rs*", 0.7),)),
    ("rails", "ruby", (("dependency", "rails", 0.8), ("dependency", "railties", 0.7), ("dependency", "actionpack", 0.6), ("dependency", "activerecord", 0.6), ("import", "rails", 0.6), ("import", "action_controller*", 0.7), ("import", "active_record*", 0.7), ("import", "action_pack*", 0.6), ("import", "action_view*", 0.5), ("symbol", "ApplicationController", 0.7), ("symbol", "ApplicationRecord", 0.6), ("file", "config/routes.rb", 0.5), ("file", "config/application.rb", 0.5),)),
    ("sinatra", "ruby", (("dependency", "sinatra", 0.8), ("import", "sinatra", 0.7),)),
    ("rake", "ruby", (("file", "Rakefile", 0.6),)),
    ("tornado", "python", (("dependency", "tornado", 0.8), ("import", "tornado", 0.7),)),
    ("aiohttp", "python", (("dependency", "aiohttp", 0.8), ("import", "aiohttp", 0.7),)),
    ("bottle", "python", (("dependency", "bottle", 0.8), ("import", "bottle", 0.7),)),
    ("pyramid", "python", (("dependency", "pyramid", 0.8), ("import", "pyramid", 0.7),)),
    ("sanic", "python", (("dependency", "sanic", 0.8), ("import", "sanic", 0.7),)),
    ("dramatiq", "python", (("dependency", "dramatiq", 0.8), ("import", "dramatiq", 0.7),)),
    ("rq", "python", (("dependency", "rq", 0.8), ("import", "rq", 0.7),)),
    ("airflow", "python", (("dependency", "apache-airflow", 0.8), ("import", "airflow", 0.7), ("file", "*dags/*", 0.2),)),
    ("koa", "javascript", (("dependency", "koa", 0.8), ("import", "koa", 0.7),)),
    ("hapi", "javascript", (("dependency", "@hapi/hapi", 0.8), ("import", "@hapi/hapi", 0.7),)),
    ("remix", "javascript", (("dependency", "@remix-run/*", 0.8), ("file", "app/routes/*", 0.3),)),
    ("hono", "javascript", (("dependency", "hono", 0.8), ("import", "hono", 0.7),)),
    ("electron", "javascript", (("dependency", "electron", 0.8), ("import", "electron", 0.7),)),
    ("socket.io", "javascript", (("dependency", "socket.io", 0.8), ("import", "socket.io", 0.7),)),
    ("fiber", "go", (("dependency", "github.com/gofiber/fiber*", 0.8), ("import", "github.com/gofiber/fiber*", 0.7),)),
    ("chi", "go", (("dependency", "github.com/go-chi/chi*", 0.8), ("import", "github.com/go-chi/chi*", 0.7),)),
    ("gorilla-mux", "go", (("dependency", "github.com/gorilla/mux", 0.8), ("import", "github.com/gorilla/mux", 0.7),)),
    ("grpc-go", "go", (("dependency", "google.golang.org/grpc", 0.8), ("import", "google.golang.org/grpc", 0.7),)),
    ("urfave-cli", "go", (("dependency", "github.com/urfave/cli*", 0.8), ("import", "github.com/urfave/cli*", 0.7),)),
    ("micronaut", "java", (("dependency", "*micronaut*", 0.8), ("import", "io.micronaut*", 0.7),)),
    ("quarkus", "java", (("dependency", "*quarkus*", 0.8), ("import", "io.quarkus*", 0.7),)),
    ("vertx", "java", (("dependency", "*vertx*", 0.8), ("import", "io.vertx*", 0.7),)),
    ("servlet-api", "java", (("import", "javax.servlet*", 0.7), ("import", "jakarta.servlet*", 0.7), ("file", "*web.xml", 0.3),)),
    ("dropwizard", "java", (("dependency", "*dropwizard*", 0.8), ("import", "io.dropwizard*", 0.7),)),
    ("hanami", "ruby", (("dependency", "hanami", 0.8), ("import", "hanami", 0.7),)),
    ("grape", "ruby", (("dependency", "grape", 0.8), ("import", "grape", 0.7),)),
    ("sidekiq", "ruby", (("dependency", "sidekiq", 0.8), ("import", "sidekiq", 0.7),)),
    ("rack", "ruby", (("dependency", "rack", 0.8), ("file", "config.ru", 0.6),)),
    ("aspnetcore", "csharp", (("dependency", "microsoft.aspnetcore*", 0.8), ("import", "Microsoft.AspNetCore*", 0.7), ("file", "*appsettings.json", 0.2),)),
    ("ef-core", "csharp", (("dependency", "microsoft.entityframeworkcore*", 0.8), ("import", "Microsoft.EntityFrameworkCore*", 0.7),)),
    ("laravel", "php", (("dependency", "laravel/framework", 0.8), ("file", "artisan", 0.5), ("file", "routes/web.php", 0.3),)),
    ("symfony", "php", (("dependency", "symfony/framework-bundle", 0.8), ("dependency", "symfony/*", 0.5), ("file", "bin/console", 0.4),)),
    ("wordpress", "php", (("file", "*wp-blog-header.php", 0.7), ("file", "*wp-login.php", 0.5), ("file", "*wp-includes/functions.php", 0.6), ("symbol", "wp_*", 0.2),)),
    ("actix-web", "rust", (("dependency", "actix-web", 0.8), ("import", "actix_web", 0.7),)),
    ("axum", "rust", (("dependency", "axum", 0.8), ("import", "axum", 0.7),)),
    ("rocket", "rust", (("dependency", "rocket", 0.8), ("import", "rocket", 0.7),)),
    ("clap", "rust", (("dependency", "clap", 0.8), ("import", "clap", 0.7),)),
    ("tokio", "rust", (("dependency", "tokio", 0.8), ("import", "tokio", 0.7),)),
    ("apollo", "javascript", (("dependency", "@apollo/server", 0.8), ("dependency", "apollo-server*", 0.8), ("dependency", "@apollo/subgraph", 0.6), ("import", "@apollo/server*", 0.7), ("import", "apollo-server*", 0.7),)),
    ("nestjs-graphql", "javascript", (("dependency", "@nestjs/graphql", 0.8), ("import", "@nestjs/graphql", 0.7),)),
    ("type-graphql", "javascript", (("dependency", "type-graphql", 0.8), ("import", "type-graphql", 0.7),)),
    ("graphql-ruby", "ruby", (("dependency", "graphql", 0.8), ("import", "graphql", 0.4), ("file", "*app/graphql/*", 0.4),)),
    ("gqlgen", "go", (("dependency", "github.com/99designs/gqlgen", 0.8), ("import", "github.com/99designs/gqlgen*", 0.7), ("file", "*gqlgen.y*ml", 0.6),)),
)
